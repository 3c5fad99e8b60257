"""Byte-pair encoding and decoding by last-token states on a trie of distinct words."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newscheck.llm import arrays as A

# Words up to so many bytes go through the trie; longer ones take the same states one by one.
TRIE_BYTES = 48
# Distinct words a Python worker remembers; beyond, it starts anew.
REMEMBERED = 1_500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHORT, _LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")


def tokenizer_bytes(path: str) -> bytes:
    """The tokenizer file, read where the job is planned."""
    with open(path, "rb") as f:
        return f.read()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for
    themselves, the others for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    """Per code point: 0 letter, 1 number, 2 other, 3 white space."""
    import unicodedata

    table = np.full(0x110000, 2, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = 0 if kind == "L" else 1
    spaces = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = 3
    return table


class Codec:
    """Encodes and decodes whole Arrow columns of texts."""

    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        kind = (spec["model"]["type"], (spec["pre_tokenizer"] or {}).get("type"), spec["normalizer"])
        if kind != ("BPE", "ByteLevel", None) or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        self.library = Tokenizer.from_str(raw.decode())
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {text.encode(): i for text, i in added.items()}
        top = max([*vocab.values(), *added.values()]) + 1
        self.token = [b""] * top
        for text, i in vocab.items():
            if text not in added:
                self.token[i] = bytes(letters[c] for c in text)
        for text, i in added.items():
            self.token[i] = text.encode()
        self.id_of = {b: i for i, b in enumerate(self.token) if b and i not in added.values()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # of a token that a merge makes: its rank and halves; single bytes have rank -1
        self.rank = np.full(top, -1, np.int64)
        self.left, self.right = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.merged = A.HashIndex()
        self.merged.add(np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.uint64))
        for k, (a, b) in enumerate(merges):
            if self.rank[t := vocab[a + b]] < 0:
                self.rank[t], self.left[t], self.right[t] = k, vocab[a], vocab[b]
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        # a token can end an encoding only if it is what its own bytes encode to
        made = np.flatnonzero(self.rank >= 0)
        whole = np.ones(top, bool)
        whole[made] = self._stand(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            whole[t] &= whole[self.left[t]] and whole[self.right[t]]
        self.reachable = {i for i in self.id_of.values() if whole[i]}
        self.usable = np.array([i for i in self.reachable if self.lengths[i] <= TRIE_BYTES], np.int64)
        self.longest = int(self.lengths[self.usable].max())
        # sizes of the tokens that end with two given bytes, the largest first
        self.single, sizes = (1,), {}
        for i in self.reachable:
            if self.lengths[i] > 1:
                sizes.setdefault(self.token[i][-2:], set()).add(int(self.lengths[i]))
        self.endings = {two: (*sorted(found, reverse=True), 1) for two, found in sizes.items()}
        # the same merges for single pairs: rank by pair; rank and halves by token
        pairs = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in reversed(list(enumerate(merges)))}
        self.ranks = pairs, list(zip(self.rank.tolist(), self.left.tolist(), self.right.tolist()))
        self.suffixes = A.HashIndex()
        self.suffixes.add(self._key(self._horner(self.usable), self.lengths[self.usable]))
        self.kinds = _classes()
        self._forget()

    def _forget(self) -> None:
        self.known = A.HashIndex()
        self.word_start = np.zeros(0, np.int64)
        self.word_count = np.zeros(0, np.int64)
        self.word_ids = np.zeros(0, np.int32)

    # -- words

    def _stand(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | int = 1 << 60) -> np.ndarray:
        """Whether tokens side by side are what their bytes encode to (up to the merges before ``limit``).

        Goes back in time from the finished tokens: of the two pieces that meet at the
        border the one made last is taken apart, and the border holds if no merge across
        it comes before that. Of equal merges the one further left is done first.
        """
        good = np.ones(len(left), bool)
        at = np.arange(len(left))
        limit = np.broadcast_to(np.asarray(limit, np.int64), left.shape).copy()
        while len(at):
            across = self.merged.find((left << 32 | right).astype(np.uint64))
            bad = (across >= 0) & (across < limit)
            good[at[bad]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~bad & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[on], left[on], right[on], a[on], b[on]
            later = a > b
            limit = np.where(later, a, b + 1)
            left, right = np.where(later, self.right[left], left), np.where(later, right, self.left[right])
        return good

    def _follows(self, left: int, right: int) -> bool:
        """:meth:`_stand` for one pair of tokens."""
        ranks, made = self.ranks
        limit = 1 << 60
        while True:
            across = ranks.get(left << 32 | right)
            if across is not None and across < limit:
                return False
            (a, _, inner), (b, outer, _) = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, inner
            else:
                limit, right = b + 1, outer

    def _one(self, raw: bytes) -> list[int]:
        """Last-token states of a single long word: the trie's steps along its one path, in linear time."""
        last, back = [0] * (len(raw) + 1), [0] * (len(raw) + 1)
        usable, follows = self.endings, self._follows
        for end in range(1, len(raw) + 1):
            for size in usable.get(raw[max(end - 2, 0) : end], self.single):
                if size <= end:
                    t = self.id_of.get(raw[end - size : end])
                    if t in self.reachable and (size == end or follows(last[end - size], t)):
                        last[end], back[end] = t, end - size
                        break
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _horner(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.uint64)
        size = self.lengths[tokens]
        for k in range(int(size.max())):
            on = np.flatnonzero(size > k)
            byte = self.flat[self.starts[tokens[on]] + k].astype(np.uint64) + np.uint64(1)
            out[on] = out[on] * _BASE + byte
        return out

    @staticmethod
    def _key(h: np.ndarray, length) -> np.ndarray:
        return A.mix(h + np.asarray(length).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def _trie(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (flat) and counts of distinct words of 1 to TRIE_BYTES bytes.

        Nodes are distinct prefixes, made level by level, so a node comes after all its
        ancestors. Its state is the last token of the encoding of its prefix: the one
        token that ends the prefix and may stand after the state of the ancestor in
        front of it. What a prefix encodes to is thus found once for all its words.
        """
        n = len(starts)
        node = np.zeros(n, np.int64)  # of each word, at this level
        last, back, top = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
        path = [np.zeros(1, np.int64)]  # ancestors of this level's nodes, root first, by level
        hashes = [np.zeros(1, np.uint64)]
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(TRIE_BYTES, _BASE)]), dtype=np.uint64)
        final = np.zeros(n, np.int64)
        alive = np.arange(n)
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            byte = data[starts[alive] + depth - 1].astype(np.int64)
            made, at = np.unique(node * 256 + byte, return_inverse=True)
            parent, byte = made >> 8, made & 255
            h = hashes[-1][parent] * _BASE + (byte.astype(np.uint64) + np.uint64(1))
            path = [p[parent] for p in path]  # global numbers
            above = [x[parent] for x in hashes]
            state, prev = np.full(len(made), -1, np.int64), np.zeros(len(made), np.int64)
            flat_last = np.concatenate(last)
            left = np.arange(len(made))
            for size in range(min(depth, self.longest), 0, -1):
                if not len(left):
                    break
                suffix = h[left] - above[depth - size][left] * powers[size]
                token = self.suffixes.find(self._key(suffix, np.full(len(left), size)))
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                cand, token = left[hit], self.usable[token[hit]]
                front = path[depth - size][cand]
                good = np.ones(len(cand), bool)
                if size < depth:
                    pair, where = np.unique(flat_last[front] << 32 | token, return_inverse=True)
                    good = self._stand(pair >> 32, pair & 0xFFFFFFFF)[where]
                state[cand[good]], prev[cand[good]] = token[good], front[good]
                left = left[state[left] < 0]
            last.append(state)
            back.append(prev)
            path.append(top + np.arange(len(made)))
            hashes = [*above, h]
            node = at
            ended = lengths[alive] == depth
            final[alive[ended]] = top + at[ended]
            top += len(made)
            alive, node = alive[~ended], node[~ended]
        flat_last, flat_back = np.concatenate(last), np.concatenate(back)
        columns, at = [], final
        while at.any():
            columns.append(np.where(at > 0, flat_last[at], -1))
            at = flat_back[at]
        if not columns:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        grid = np.stack(columns[::-1], 1)
        return grid[grid >= 0].astype(np.int32), (grid >= 0).sum(1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        """Encode words not met before."""
        new, first = np.unique(h, return_index=True)
        starts, lengths = starts[first], (ends - starts)[first]
        short = lengths <= TRIE_BYTES
        ids, counts = self._trie(data, starts[short], lengths[short])
        at = np.cumsum(counts) - counts
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        extra = [self._one(data[s : s + n].tobytes()) for s, n in zip(starts[~short], lengths[~short])]
        more = np.array([len(x) for x in extra], np.int64)
        base = len(self.word_ids)
        self.known.add(new[order])
        self.word_start = np.concatenate([self.word_start, base + at, base + len(ids) + np.cumsum(more) - more])
        self.word_count = np.concatenate([self.word_count, counts, more])
        self.word_ids = np.concatenate([self.word_ids, ids, *[np.array(x, np.int32) for x in extra]])

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where the pieces begin that are encoded apart.

        A piece is a run of letters, of numbers or of other signs, with the blank before
        it; a clitic after an apostrophe; or white space up to the next piece.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kinds[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):  # the bytes of a longer sign have its kind
            head = data[lead].astype(np.uint32)
            more = 1 + (head >= 0xE0).astype(np.int64) + (head >= 0xF0)
            cp = head & (np.uint32(0xFF) >> (more + 2).astype(np.uint32))
            for k in (1, 2, 3):
                on = more >= k
                cp[on] = cp[on] << 6 | (data[lead[on] + k] & 0x3F)
            own = self.kinds[cp]
            kind[lead] = own
            for k in (1, 2, 3):
                on = more >= k
                kind[lead[on] + k] = own[on]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        fresh, final = border[:-1], border[1:]
        start = fresh.copy()
        start[1:] |= kind[1:] != kind[:-1]
        white = kind == 3
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~final[:-1])  # white space with something else after it
        joined = last[data[last] == 32] + 1
        if len(lead):
            while len(inner := np.flatnonzero((data[last] & 0xC0) == 0x80)):
                last[inner] -= 1
        start[last] = True
        start[joined] = False
        mark = np.flatnonzero(data == 39)
        mark = mark[start[mark]]
        if len(mark):
            padded = np.concatenate([data, np.zeros(2, np.uint8)])
            one, two = padded[mark + 1], padded[mark + 2]
            same1 = ~border[mark + 1]
            same2 = same1 & ~border[np.minimum(mark + 2, n)]
            short = same1 & np.isin(one, [ord(c) for c in _SHORT])
            long = np.zeros(len(mark), bool)
            for a, b in _LONG:
                long |= same2 & (one == ord(a)) & (two == ord(b))
            for hit, size in ((short, 2), (long & ~short, 3)):
                at = mark[hit]
                start[at + 1] = False
                after = at + size
                start[after[after < n]] = True
        return np.flatnonzero(start)

    # -- texts

    def _encode_piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._split(data, offsets)
        ends = np.append(starts[1:], len(data))
        h = A.span_hashes(data, starts, ends)
        if self.known.size > REMEMBERED:
            self._forget()
        word = self.known.find(h)
        new = np.flatnonzero(word < 0)
        if len(new):
            self._learn(data, starts[new], ends[new], h[new])
            word[new] = self.known.find(h[new])
        counts = self.word_count[word]
        ids = self.word_ids[A.ragged(self.word_start[word], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return ids, sums[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens in a row."""
        return self.flat[A.ragged(self.starts[ids], self.lengths[ids])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, where each text's begin, and the bytes decoded from them.

        Texts with a special token's string, and any whose bytes do not come back (two
        words of one hash), are encoded by the library.
        """
        ids, begin = self._encode_piece(data, offsets)
        back = self.decode(ids)
        odd: set[int] = set()
        raw = data.tobytes()
        for text in self.special:
            at = raw.find(text)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(text, at + 1)
        if len(back) != len(data) or not np.array_equal(back, data):
            for k in range(len(offsets) - 1):
                mine = self.decode(ids[begin[k] : begin[k + 1]])
                if not np.array_equal(mine, data[offsets[k] : offsets[k + 1]]):
                    odd.add(k)
        if odd:
            parts = [ids[begin[k] : begin[k + 1]] for k in range(len(offsets) - 1)]
            for k in odd:
                text = raw[offsets[k] : offsets[k + 1]].decode()
                parts[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            ids = np.concatenate(parts)
            begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            back = self.decode(ids)
        return ids, begin, back


def codec(raw: bytes) -> Codec:
    """The codec of a tokenizer file, made once in each Python process."""
    return A.per_process(("codec", hashlib.md5(raw).hexdigest()), lambda: Codec(raw))


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` to ``doc_id, ids, decoded``: token ids of the whole text, and the text they give.

    A null or empty text has no ids and decodes to the empty text. Rows are taken one by
    one: repeated rows and null ids stay, other columns are not read. No shuffle.
    """
    raw = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(raw.value)
        for batch in batches:
            for first, last, data, offsets in A.pieces(*A.text_buffer(batch.column("text"))):
                ids, begin, back = coder.encode(data, offsets)
                sizes = np.concatenate([[0], np.cumsum(coder.lengths[ids])])[begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array([back[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(sizes, sizes[1:])], pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(A.tidy(run, "codec"), "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of what :func:`encode_decode` gives.

    Taken where the ids are, so that no ids travel. Same cases as there; the digest of no
    ids is that of no bytes.
    """
    raw = docs.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(raw.value)
        for batch in batches:
            for first, last, data, offsets in A.pieces(*A.text_buffer(batch.column("text"))):
                ids, begin, back = coder.encode(data, offsets)
                sizes = np.concatenate([[0], np.cumsum(coder.lengths[ids])])[begin]
                little = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.array(np.diff(begin), pa.int64()),
                        pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(begin, begin[1:])]),
                        pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(sizes, sizes[1:])]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        A.tidy(run, "codec"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
