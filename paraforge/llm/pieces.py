"""Whole texts to token ids, each distinct piece of a batch encoded once by the tokenizer library.

A tokenizer works on independent pieces of a text (words with their leading white space). Pieces
are cut at the file's added tokens first, then with vectorised rules on code points; distinct pieces of a bounded slice are found by hash,
and the library encodes only those that a bounded memo does not hold. The result equals the
library's own on the whole text (tested), at a fraction of the time, as words repeat.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pandas as pd

from paraforge.llm.words import U64, mix, powers

LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0
MEMO_PIECES = 400_000


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    import regex

    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]):ord(m[0][-1]) + 1] = kind
    return table


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice of UTF-8 texts, and the row offsets counted in code points."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    leads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    return codes, leads[off]


def byte_level_starts(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Piece starts of the byte-level pattern: contractions, optional space with letters, numbers or
    other characters, white space before them less its last character, other white space."""
    n = len(codes)
    kind = char_classes()[codes]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True  # also n: the end of the last row
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    space = codes == 32
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = space[:-1]
    after_space &= ~first[:n]
    before_solid = np.zeros(n, dtype=bool)
    before_solid[:-1] = ~white[1:]
    before_solid &= ~first[1:]
    start = np.where(white, run | before_solid, run & ~after_space)
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, np.uint32)])
        edge = np.concatenate([first, np.ones(2, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = ~edge[quote + 1] & np.isin(a, [ord(x) for x in "stmd"])
        two = ~edge[quote + 1] & ~edge[quote + 2] & np.logical_or.reduce(
            [(a == ord(x[0])) & (b == ord(x[1])) for x in ("re", "ve", "ll")])
        size = np.where(one, 2, np.where(two, 3, 0))
        hit, size = quote[size > 0], size[size > 0]
        start[hit + 1] = False
        after = hit + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Encode pieces with ``encode(text) -> ids``, keeping those of the latest distinct pieces."""

    def __init__(self, encode, starts):
        self.encode, self.starts = encode, starts
        self._forget()

    def _forget(self) -> None:
        self.memo, self.flat, self.edge = {}, array("I"), array("q", [0])

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and the number of ids of each row."""
        rows = len(off) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        codes, at = code_points(data, off)
        starts = self.starts(codes, at)
        ends = np.append(starts[1:], len(codes))
        up, down = powers(11, len(codes))
        sums = np.zeros(len(codes) + 1, dtype=U64)
        np.cumsum((codes.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) * up[:len(codes)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(U64))
        kinds, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), dtype=np.int64)
        first[kinds[::-1]] = np.arange(len(kinds))[::-1]
        text = codes.tobytes().decode("utf-32-le")
        places = self._places([text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        edge = np.frombuffer(self.edge, dtype=np.int64)
        base = edge[places][kinds]  # the two views end with this call, so the memo can grow again
        per = (edge[places + 1] - edge[places])[kinds]
        total = np.cumsum(per)
        flat = np.frombuffer(self.flat, dtype=np.uint32)
        out = flat[np.repeat(base - (total - per), per) + np.arange(total[-1])]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, at)]
        return out, np.diff(upto)

    def _places(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece's ids in ``edge``; unknown pieces are encoded."""
        if len(self.memo) > MEMO_PIECES or len(self.flat) > 16 * MEMO_PIECES:
            self._forget()
        get = self.memo.get
        found = np.fromiter((get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        for i in np.flatnonzero(found < 0).tolist():
            piece = pieces[i]
            found[i] = self.memo[piece] = len(self.edge) - 1
            self.flat.extend(self.encode(piece))
            self.edge.append(len(self.flat))
        return found


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, int]:
    """The letter by which byte-level BPE files write each byte: printable Latin-1 letters stand
    for themselves, the other bytes are numbered from U+0100."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in itself]
    return {b: b for b in itself} | {b: 256 + i for i, b in enumerate(others)}


def cut_at(literals: list[str], starts):
    """``starts`` on texts cut at the literals (leftmost, then longest): each is a piece, and the texts between them
    stand alone."""
    import regex

    find = regex.compile("|".join(map(regex.escape, sorted(literals, key=len, reverse=True))))

    def run(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        text = codes.tobytes().decode("utf-32-le")
        if not any(x in text for x in literals):
            return starts(codes, off)
        cuts, own = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            for m in find.finditer(text[a:b]):
                cuts += (a + m.start(), a + m.end())
                own.append((a + m.start(), a + m.end()))
        at = starts(codes, np.unique(np.concatenate([off, np.array(cuts, dtype=off.dtype)])))
        inside = np.zeros(len(codes) + 1, dtype=bool)
        for a, b in own:
            inside[a + 1:b] = True
        return at[~inside[at]]
    return run


@lru_cache(maxsize=2)
def byte_level_encoder(path: str, added_tokens: bool = False) -> PieceEncoder:
    """For a byte-level BPE file of the tokenizers library; one per Python worker. With ``added_tokens``, those of the
    file that stand in a text get their ids, as by the library's default settings; else they are text like any other
    (the library's ``encode_special_tokens``)."""
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), byte_letters()
    model, known = tokenizer.model, tokenizer.get_added_tokens_decoder() if added_tokens else {}
    added = {t.content: i for i, t in known.items()}
    for t in known.values():
        if t.lstrip or t.rstrip or t.single_word:
            raise ValueError(f"added token {t.content!r} takes in or looks at its surroundings, which is not supported")

    def encode(piece: str) -> list[int]:
        if piece in added:
            return [added[piece]]
        return [t.id for t in model.tokenize(piece.encode("utf-8").decode("latin-1").translate(letters))]

    return PieceEncoder(encode, cut_at(list(added), byte_level_starts) if added else byte_level_starts)
