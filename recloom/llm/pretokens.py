"""Cutting text at places where a byte-level tokenizer's pattern always cuts, so that pieces can be kept in a cache.

The pattern (see ``public_tokenizers.PATTERN``) lets a piece start with at most one space before its letters, digits or
marks.  It therefore always cuts, whatever stands around,

* before a space between two characters that are no white space,
* before and after a line feed between two such characters,
* between a letter or digit and a full stop or comma that is followed by a space or a line feed.

Texts fall there into chunks that are encoded alike wherever they occur.  A text with other white space at such a place (or
with the mark character) is encoded whole.  This holds for ``PATTERN`` alone; with another one, callers encode whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern of byte-level tokenizers for which the cuts hold.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are cut up at once, and chunks that a process keeps (some 200 bytes each); both bound memory.
SLICE, KEPT = 1 << 21, 1_000_000
#: Stands before a chunk that has no space before it.
MARK = "\x02"


class Chunks:
    """Encodes texts to bytes of little-endian 32-bit ids.  ``many`` encodes strings, chunks or whole texts, to such bytes.
    Arrow splits a slice of texts and numbers its distinct chunks, so that only those are seen by Python."""

    def __init__(self, many: Callable[[list[str]], list[bytes]], most: int | None = None):
        self.many, self.kept, self.most = many, {}, most

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            yield from self._some(texts[at:end])
            pa.default_memory_pool().release_unused()
            at = end

    def _ids(self, wanted: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of each chunk, and which of them don't stand as a chunk must."""
        kept = self.kept
        got = [kept.get(x) for x in wanted]
        new = [i for i, x in enumerate(got) if x is None]
        bad = np.zeros(len(wanted), bool)
        texts, at = [], []
        for i in new:
            x = wanted[i]
            text = x[1:] if x[:1] == MARK else " " + x
            core = x.lstrip(MARK)
            if core and (x == MARK + "\n" or not (core[0].isspace() or core[-1].isspace())):
                texts.append(text)
                at.append(i)
            else:
                bad[i], got[i] = True, b""
        if len(kept) + len(texts) > (self.most or KEPT):
            kept.clear()
        for i, ids in zip(at, self.many(texts), strict=True):
            got[i] = kept[wanted[i]] = ids
        return got, bad

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        own = pa.array(texts, pa.large_string())
        marked = pc.match_substring(own, MARK).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pa.array([MARK + t for t in texts], pa.large_string()), "\n", f" {MARK}\n {MARK}")
        cut = pc.replace_substring_regex(cut, r"([\pL\pN])([.,]) ", rf"\1 {MARK}\2 ")
        cut = pc.split_pattern(cut, " ")
        offsets = cut.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = cut.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        blobs, bad = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), "<u4")
        start = np.cumsum(size) - size
        n = size[at]
        done = np.cumsum(n)
        ids = flat[np.repeat(start[at] - (done - n), n) + np.arange(int(done[-1]) if len(done) else 0)]
        ends = done[offsets[1:] - 1].tolist()
        odd = marked | (np.add.reduceat(bad[at].astype(np.int64), offsets[:-1]) > 0)
        whole = np.flatnonzero(odd).tolist()
        again = dict(zip(whole, self.many([texts[i] for i in whole]), strict=True)) if whole else {}
        begin = 0
        for i, end in enumerate(ends):
            yield again[i] if i in again else ids[begin:end].tobytes()
            begin = end
