"""Byte-level BPE by speculation and verification.

A text is cut into words by the byte-level pre-tokenizer's rule.  Words are cut
with array operations over the whole batch, and each distinct word is encoded
once per worker:

1. *Speculate*: greedy longest match against the vocabulary proposes tokens.
2. *Verify*: every adjacent pair of proposed tokens, over all new words at once,
   is tested for compatibility: undoing the merges on both sides of the seam must
   never reveal a merge that BPE would have made across it.  A token sequence is
   the BPE encoding exactly when all its adjacent pairs are compatible.
3. Words with an incompatible pair are merged exactly, lowest rank first.

The vocabulary's path is a parameter.
"""

from __future__ import annotations

import functools
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER, INSIDE = 0, 1, 2, 3, 4
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words are looked up by their bytes in two 64-bit halves up to this length.
SHORT = 16
#: Bytes of text that are encoded at once, which bounds a worker's memory; a longer text is cut where a word surely begins.
STEP = 512 << 10
#: Such places: the space between two ASCII letters, and a CJK ideograph after a full stop or comma.
SAFE = regex.compile(rb"(?<=[A-Za-z])(?= [A-Za-z])|(?<=\xe3\x80\x82|\xef\xbc\x8c)(?=[\xe5-\xe8])")


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point."""
    major = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_SPACE] = SPACE
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` library.

    Only byte-level BPE without normalizer, prefix space and continuing-word
    marks is accepted; merges must have ascending ids, which makes an id a rank.
    """

    def __init__(self, path: str, slots: int = 1 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        to_byte = byte_alphabet()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        self.vocab = {as_bytes(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for b, i in self.vocab.items():
            self.pieces[i] = b
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        self.piece_size = np.fromiter(map(len, self.pieces), np.int64, size)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[as_bytes(a)] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[as_bytes(b)] for _, b in pairs], np.int64)
        made = np.array([self.vocab[as_bytes(a + b)] for a, b in pairs], np.int64)
        if (np.diff(made) <= 0).any():
            raise ValueError("merges must be in the order of their ids")
        self.split_left, self.split_right = np.arange(size), np.arange(size)
        self.split_left[made], self.split_right[made] = left, right
        key = left * size + right
        order = np.argsort(key)
        self.merge_keys, self.merge_made, self.size = key[order], made[order], size
        self.rank = {(int(a), int(b)): int(c) for a, b, c in zip(left, right, made, strict=True)}
        self.byte_ids = [self.vocab[bytes([b])] for b in range(256)]
        self.longest = [0] * 256
        for b in self.vocab:
            self.longest[b[0]] = max(self.longest[b[0]], len(b))
        self._grow_trie()
        self.specials = regex.compile(b"(" + b"|".join(regex.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.slots = slots
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.speculated = self.failed = 0
        self._forget()

    def _forget(self) -> None:
        """Empty the cache of words: a direct-mapped table of their bytes, and the ids end to end."""
        self.lo, self.hi = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.at, self.n = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int8)
        self.flat, self.filled = np.empty(1 << 20, np.int32), 0

    # -- one word ---------------------------------------------------------

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, end, vocab, longest = [], 0, len(word), self.vocab, self.longest
        while at < end:
            stop = min(end, at + longest[word[at]])
            while (t := vocab.get(word[at:stop])) is None:
                stop -= 1
            out.append(t)
            at = stop
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """BPE merging in order of rank, leftmost first, with a heap over a linked list."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) < 2:
            return ids
        rank = self.rank
        if len(ids) <= 24:
            while len(ids) > 1:
                best, where = min((rank.get(p, 1 << 40), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
                if best == 1 << 40:
                    break
                ids[where : where + 2] = [best]
            return ids
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank.get((made, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, made, ids[after[i]]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], made))) is not None:
                heapq.heappush(heap, (r, h, ids[h], made))
        return [t for t in ids if t >= 0]

    # -- many words -------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: do they stay apart where ``a`` meets ``b``?"""
        ok = np.ones(len(a), bool)
        left, right = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            key = left * self.size + right
            spot = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            crossed = (self.merge_keys[spot] == key) & (self.merge_made[spot] < limit)
            ok[live[crossed]] = False
            # undo the later of the two merges; a base token can't be undone, then the other is
            part_l, part_r = self.split_right[left], self.split_left[right]
            base_l, base_r = part_l == left, part_r == right
            undo_left = np.where(base_l, False, np.where(base_r, True, left > right))
            go = ~crossed & ~(base_l & base_r)
            limit = np.where(undo_left, left, right + 1)
            left, right = np.where(undo_left, part_l, left), np.where(undo_left, right, part_r)
            live, left, right, limit = live[go], left[go], right[go], limit[go]
        return ok

    def _grow_trie(self) -> None:
        """Transitions of the vocabulary's prefixes as sorted keys node * 256 + byte."""
        nodes = {b"": 0}
        for b in self.vocab:
            for i in range(1, len(b) + 1):
                nodes.setdefault(b[:i], len(nodes))
        edges = sorted((nodes[b[:-1]] * 256 + b[-1], n, self.vocab.get(b, -1)) for b, n in nodes.items() if b)
        self.edge_keys, self.edge_node, self.edge_token = (np.array(x, np.int64) for x in zip(*edges, strict=True))

    def propose_all(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over the rows of a byte matrix: ids and counts."""
        n, width = chars.shape
        ids, count = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        node, begin, best, past = (np.zeros(n, np.int64) for _ in range(4))
        at = np.zeros(n, np.int64)
        while live.size:
            more = at < length[live]
            key = node * 256 + chars[live, np.minimum(at, width - 1)]
            spot = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            more &= self.edge_keys[spot] == key
            token = np.where(more, self.edge_token[spot], -1)
            hit = token >= 0
            best, past = np.where(hit, token, best), np.where(hit, at + 1, past)
            node, at = np.where(more, self.edge_node[spot], 0), at + 1
            if not more.all():
                done = ~more
                rows = live[done]
                ids[rows, count[rows]] = best[done]
                count[rows] += 1
                begin, at = np.where(done, past, begin), np.where(done, past, at)
                keep = ~done | (past < length[live])
                live, node, begin, best, past, at = live[keep], node[keep], begin[keep], best[keep], past[keep], at[keep]
        return ids, count

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        spot = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.merge_keys[spot] == key), self.merge_made[spot], 1 << 40)

    def merge_all(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of the rows of a byte matrix, one merge of each row at a time."""
        n, width = chars.shape
        out, count = np.full((n, width), -1, np.int64), np.zeros(n, np.int64)
        ids = np.where(np.arange(width) < length[:, None], np.array(self.byte_ids)[chars], -1)
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live, columns = np.arange(n), np.arange(width + 1)
        while live.size:
            j = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            made = ranks[rows, j]
            done = made == 1 << 40
            if done.any():
                out[live[done]] = ids[done, :-1]
                keep = ~done
                live, ids, ranks, j, made = live[keep], ids[keep], ranks[keep], j[keep], made[keep]
                rows = np.arange(len(live))
                if not live.size:
                    break
            ids[rows, j] = made
            shift = columns[None, :] + (columns[None, :] > j[:, None])
            ids = np.take_along_axis(np.concatenate([ids, np.full((len(live), 1), -1)], axis=1), shift, axis=1)
            ranks = np.take_along_axis(np.concatenate([ranks, np.full((len(live), 1), 1 << 40)], axis=1), shift[:, :-1], axis=1)
            ranks[rows, j] = self._ranks(made, ids[rows, j + 1])
            prior = j > 0
            ranks[rows[prior], j[prior] - 1] = self._ranks(ids[rows[prior], j[prior] - 1], made[prior])
        count = (out >= 0).sum(axis=1)
        return out, count

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of any length."""
        known = {w: self.propose(w) for w in words}
        flat = np.fromiter((t for x in known.values() for t in x), np.int64)
        owner = np.repeat(np.arange(len(known)), np.fromiter(map(len, known.values()), np.int64, len(known)))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = set(owner[inner[~self.compatible(flat[inner], flat[inner + 1])]].tolist())
        self.speculated += len(known)
        self.failed += len(bad)
        for i, w in enumerate(list(known)):
            if i in bad:
                known[w] = self.merge_exactly(w)
        return [known[w] for w in words]

    def encode_short(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of words given as rows of a byte matrix."""
        if not len(chars):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids, n = self.propose_all(chars, length)
        column = np.arange(chars.shape[1])
        row, col = np.nonzero(column[None, :-1] + 1 < n[:, None])
        key, back = np.unique(ids[row, col] * self.size + ids[row, col + 1], return_inverse=True)
        bad = np.unique(row[~self.compatible(key // self.size, key % self.size)[back]])
        if bad.size:
            ids[bad], n[bad] = self.merge_all(chars[bad], length[bad])
        self.failed += len(bad)
        self.speculated += len(chars)
        return ids[column[None, :] < n[:, None]], n

    # -- many texts -------------------------------------------------------

    def word_starts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Offsets at which the pre-tokenizer's words begin in the joined UTF-8 texts.

        ``ends``: offset at which each non-empty text ends.
        """
        n = len(data)
        kind = char_classes()[:128][np.minimum(data, 127)]
        if (high := np.flatnonzero(data >= 0x80)).size:
            b = data[high]
            kind[high] = INSIDE
            for first, past, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
                at = high[(b >= first) & (b < past)]
                if at.size:
                    point = (data[at] & bits).astype(np.int64)
                    for k in range(1, more + 1):
                        point = (point << 6) | (data[at + k] & 0x3F)
                    kind[at] = char_classes()[point]
            whole = np.flatnonzero(kind != INSIDE)
        else:
            whole = np.arange(n)
        k = kind[whole]
        first = np.zeros(len(whole), bool)
        first[0] = True
        text_start = np.zeros(n + 1, bool)
        text_start[0] = True
        text_start[ends] = True
        opens = text_start[whole]
        closes = np.append(opens[1:], True)
        first[1:] = k[1:] != k[:-1]
        first |= opens
        # a white-space run before a visible character gives up its last character
        space = k == SPACE
        last_of_run = space & ~closes & np.append(~space[1:], True)
        first |= last_of_run
        # a plain space joins the word after it
        plain = last_of_run & (data[whole] == 0x20)
        first[1:][plain[:-1]] = False
        # contractions
        quote = np.flatnonzero((data[whole] == 0x27) & first)
        for i in quote.tolist():
            if i + 1 < len(whole) and k[i + 1] == LETTER and first[i + 1] and not closes[i]:
                p, stop = int(whole[i]), int(ends[np.searchsorted(ends, whole[i], side="right")])
                tail = data[p + 1 : min(p + 3, stop)].tobytes()
                take = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
                if take:
                    first[i + 1] = False
                    if i + 1 + take < len(whole):
                        j = i + 1 + take
                        # what follows opens a word, unless a space run's rule has placed the start already
                        if k[j] == LETTER:
                            first[j] = True
        return whole[first]

    def spans(self, text: bytes) -> Iterator[bytes | int]:
        """The text in parts that are encoded by themselves: spans of about ``STEP`` bytes, and ids of special tokens, which are cut out first."""
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                yield self.special[part.decode()]
                continue
            at = 0
            while len(part) - at > STEP and (m := SAFE.search(part, at + STEP)):
                yield part[at : m.start()]
                at = m.start()
            if at < len(part):
                yield part[at:] if at else part

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each text has."""
        counts = np.zeros(len(texts), np.int64)
        out, group, owners, size = [np.empty(0, np.int32)], [], [], 0

        def flush() -> None:
            nonlocal size
            ids, n = self._encode_spans(group)
            out.append(ids)
            np.add.at(counts, owners, n)
            group.clear()
            owners.clear()
            size = 0

        for row, text in enumerate(texts):
            for part in self.spans(text):
                if isinstance(part, int):
                    flush()
                    out.append(np.array([part], np.int32))
                    counts[row] += 1
                    continue
                if size + len(part) > STEP and group:
                    flush()
                group.append(part)
                owners.append(row)
                size += len(part)
        flush()
        return np.concatenate(out), counts

    def _encode_spans(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts without special tokens, and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(size.sum())
        if not total:
            return np.empty(0, np.int32), counts
        padded = np.frombuffer(b"".join(texts) + b"\0" * (SHORT + 8), np.uint8)
        data, ends = padded[:total], np.cumsum(size)
        start = self.word_starts(data, ends[size > 0])
        length = np.diff(np.append(start, total))
        eight = np.empty(total + SHORT, np.uint64)
        for r in range(8):
            view = padded[r : r + (len(padded) - r) // 8 * 8].view("<u8")
            eight[r::8] = view[: len(eight[r::8])]
        mask = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
        lo = eight[start] & mask[np.minimum(length, 8)]
        hi = eight[start + 8] & mask[np.clip(length - 8, 0, 8)]
        with np.errstate(over="ignore"):
            key = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ ((hi + length.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        where = (key >> self.shift).astype(np.int64)
        # a word's bytes hold no zero past its end, so equal halves are equal words, but for words that end in zero bytes
        plain = (length <= SHORT) & (data[start + length - 1] != 0)
        hit = plain & (self.lo[where] == lo) & (self.hi[where] == hi)
        many, src = self.n[where].astype(np.int64), self.at[where].astype(np.int64)
        ids_from = [(hit, self.flat, src)]
        if (fresh := np.flatnonzero(plain & ~hit)).size:
            order = np.lexsort((hi[fresh], lo[fresh]))
            f = fresh[order]
            new = np.append(True, (lo[f[1:]] != lo[f[:-1]]) | (hi[f[1:]] != hi[f[:-1]]))
            first, back = f[new], np.cumsum(new) - 1
            chars = np.stack([lo[first], hi[first]], axis=1).view(np.uint8).reshape(-1, SHORT)
            ids, n = self.encode_short(chars, length[first])
            at = np.cumsum(n) - n
            many[f], src[f] = n[back], at[back]
            mark = np.zeros(len(start), bool)
            mark[f] = True
            ids_from.append((mark, ids, src))
            self._remember(where[first], lo[first], hi[first], ids, n, at)
        if (long := np.flatnonzero(~plain)).size:
            words = [data[a:b].tobytes() for a, b in zip(start[long].tolist(), (start + length)[long].tolist(), strict=True)]
            ids = self.encode_words(words)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            many[long], src[long] = n, np.cumsum(n) - n
            ids_from.append((~plain, np.fromiter((t for x in ids for t in x), np.int32, int(n.sum())), src))
        begin = np.cumsum(many) - many
        flat = np.empty(int(many.sum()), np.int32)
        for mask, source, src in ids_from:
            m = many[mask]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            flat[np.repeat(begin[mask], m) + step] = source[np.repeat(src[mask], m) + step]
        owner = np.searchsorted(ends, start, side="right")
        counts += np.bincount(owner, weights=many, minlength=len(texts)).astype(np.int64)
        return flat, counts

    def _remember(self, where: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> None:
        """Put words in the table; of those that share a slot the last stays."""
        if self.filled + len(ids) > 1 << 22:
            self._forget()
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        owner = np.empty(self.slots if len(where) > self.slots // 8 else int(where.max()) + 1, np.int32)
        owner[where] = np.arange(len(where))
        last = np.unique(owner[where])
        self.lo[where[last]], self.hi[where[last]] = lo[last], hi[last]
        self.n[where[last]], self.at[where[last]] = n[last], at[last] + self.filled
        self.filled += len(ids)

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        n = self.piece_size[ids]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        raw = self.piece_bytes[np.repeat(self.piece_at[ids], n) + step].tobytes()
        ends = np.append(0, np.cumsum(n))[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def load(path: str) -> ByteBPE:
    """One encoder, with its cache of words, for each worker process."""
    return ByteBPE(path)
