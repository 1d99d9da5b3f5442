"""Token ids of whole texts, by a public vocabulary."""

from __future__ import annotations

import os
from itertools import chain, pairwise

import numpy as np

from .common import kept, mixed

#: Coded segments that a worker's table remembers at most.
SEGMENTS = 1 << 19
#: Longer segments are not remembered; text bytes looked up together; bytes of new segments that the library gets as one text, and such texts in a call.
LONGEST, BATCH_BYTES, JOINED_BYTES, CALL = 32, 4 << 20, 4 << 10, 32


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coder(path: str) -> Coder:
    """The coder of this worker for a vocabulary file; every node has the file at that path."""
    return kept(f"coder {path}", lambda: Coder(path), "tokens")


class Segments:
    """An open-addressing table from segments of at most ``LONGEST`` bytes, as four words, to their ids; whole columns are looked up at once."""

    def __init__(self, most: int):
        self.most, self.mask = most, np.uint64((1 << (4 * most - 1).bit_length()) - 1)
        self._empty()

    def _empty(self) -> None:
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self.words, self.at, self.n, self.used = np.zeros((self.most, 4), np.uint64), np.zeros(self.most, np.int64), np.zeros(self.most, np.int32), np.zeros(self.most, np.uint16)
        self.size, self.pool, self.end = 0, np.zeros(1 << 20, np.uint32), 0

    def find(self, words: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The entry of each column of words, or -1."""
        out, todo, place = np.full(len(key), -1, np.int64), np.arange(len(key)), key & self.mask
        while len(todo):
            entry = self.slot[place]
            there = entry >= 0
            todo, place, entry = todo[there], place[there], entry[there]
            same = (self.words[entry] == words[todo]).all(axis=1)
            out[todo[same]] = entry[same]
            todo, place = todo[~same], (place[~same] + np.uint64(1)) & self.mask
        hit = out[out >= 0]
        self.used[hit] = np.minimum(self.used[hit], 1 << 14) + 1  # once for all columns of a call
        return out

    def add(self, words: np.ndarray, key: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New, distinct segments and their ids one after the other."""
        if self.size + len(key) > self.most:
            self._keep_used(len(key))
        if len(key) > self.most - self.size:
            return
        while self.end + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        entry = np.arange(self.size, self.size + len(key))
        self.words[entry], self.n[entry], self.at[entry] = words, n, self.end + np.cumsum(n) - n
        self.used[entry] = 1
        self.pool[self.end:self.end + len(ids)] = ids
        self.size, self.end = self.size + len(key), self.end + len(ids)
        place = key & self.mask
        while len(entry):
            free = self.slot[place] < 0
            self.slot[place[free]] = entry[free]
            left = self.slot[place] != entry
            entry, place = entry[left], (place[left] + np.uint64(1)) & self.mask

    def _keep_used(self, wanted: int) -> None:
        """Forget what the fewest calls used, of equals the oldest, until half of the room is free; uses of long ago count less."""
        room = max(0, self.most // 2 - wanted)
        rank = self.used[:self.size].astype(np.int64) << 32 | np.arange(self.size)
        keep = np.sort(np.argpartition(rank, self.size - room)[self.size - room:]) if 0 < room < self.size else np.arange(min(room, self.size))
        words, n, used = self.words[keep], self.n[keep], self.used[keep] >> 1
        ids = self.pool[_ranges(self.at[keep], n)]
        self._empty()
        self.add(words, _key(words), ids, n)
        self.used[:len(keep)] = used


def _key(words: np.ndarray) -> np.ndarray:
    return mixed(words[:, 0] ^ mixed(words[:, 1] ^ mixed(words[:, 2] ^ mixed(words[:, 3]))))


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``at[i] ... at[i] + n[i] - 1`` for all i in turn."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Coder:
    """Codes texts by segments.

    The vocabulary's own pattern never joins text across a single space between two characters that
    are not blank, so a text may be cut before each such space, and the ids of a segment remembered.
    For the same reason new segments between two cuts can be strung together and coded as one text;
    the lengths of the tokens tell where the ids of each end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(names.values()) + 1, np.int64)  # a sign of a byte-level token stands for a byte
        self.lengths[list(names.values())] = list(map(len, names))
        self.segments = Segments(SEGMENTS)
        solid = np.zeros(256, bool)  # last bytes and first bytes of characters that are surely not blank
        solid[0x21:0x7F] = True
        self.solid, self.lead = solid, np.zeros(256, bool)
        self.lead[0xC3:0xE0] = True
        self.low = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)

    def code(self, texts: list[str | None], added: bool = False) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty.

        The names of special tokens that stand in a text are plain text, or with ``added`` these tokens, as by the library's default.
        """
        if added:
            whole = {k: self._whole(t) for k, t in enumerate(texts) if t and any(name in t for name in self.added)}
            if whole:
                rest = self.code([None if k in whole else t for k, t in enumerate(texts)])
                return [whole.get(k, ids) for k, ids in enumerate(rest)]
        data, found, at, size = [(t or "").encode() for t in texts], [], 0, 0
        for k, text in enumerate(data):
            size += len(text)
            if size > BATCH_BYTES or k == len(data) - 1:
                found += self._code(data[at:k + 1])
                at, size = k + 1, 0
        return found

    def _whole(self, text: str) -> bytes:
        """Ids of a text that holds added tokens, which its segments would cut."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def _code(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(sizes.sum())
        if not total:
            return [b""] * len(texts)
        data = np.frombuffer(b"\0\0" + b"".join(texts) + bytes(LONGEST + 8), np.uint8)[2:]
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        spaces = np.flatnonzero(data[:total] == 0x20)
        before, earlier, after = data[spaces - 1], data[np.maximum(spaces - 2, 0)], data[spaces + 1]
        cut = (self.solid[before] | ((before >= 0x80) & self.lead[earlier])) & (self.solid[after] | self.lead[after]) & (spaces > 1)
        starts = np.zeros(total, bool)
        starts[firsts] = starts[spaces[cut]] = True
        start = np.flatnonzero(starts)
        size = np.diff(np.concatenate([start, [total]]))
        words = np.zeros((len(start), 4), np.uint64)
        every = np.ndarray((total + LONGEST,), "<u8", data, 0, (1,))
        for k in range(4):
            long = np.flatnonzero(size > 8 * k) if k else slice(None)
            words[long, k] = every[start[long] + 8 * k] & self.low[np.minimum(size[long] - 8 * k, 8)]
        # A segment with trailing zero bytes must not look like a shorter one: zeros are never remembered.
        plain = (size <= LONGEST) & (data[start + size - 1] != 0)
        key, entry = _key(words), np.full(len(start), -1, np.int64)
        entry[plain] = self.segments.find(words[plain], key[plain])
        table = self.segments
        lost = np.flatnonzero(entry < 0)
        own, n = table.at[entry], table.n[entry].astype(np.int64)
        pool = table.pool
        if len(lost):
            raw, new = data[:total].tobytes(), {}
            names = [raw[a:b] for a, b in zip(start[lost].tolist(), (start + size)[lost].tolist(), strict=True)]
            which = np.fromiter((new.setdefault(name, len(new)) for name in names), np.int64, len(names))
            _, one = np.unique(which, return_index=True)
            one = lost[one]
            between = np.zeros(total + 1, bool)
            between[spaces[cut]] = True
            between[firsts] = False
            ids, counts = self._new(list(new), between[start[one]] & between[(start + size)[one]])
            own[lost], n[lost] = (table.end + np.cumsum(counts) - counts)[which], counts[which]
            pool = np.concatenate([pool[:table.end], ids])
            kept_too = plain[one]
            table.add(words[one[kept_too]], key[one[kept_too]], ids[np.repeat(kept_too, counts)], counts[kept_too])
        out = pool[_ranges(own, n)].astype("<u4")
        raw, upto = out.tobytes(), np.concatenate([[0], np.cumsum(n)])
        ends = (4 * upto[np.searchsorted(start, np.cumsum(sizes))]).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _new(self, names: list[bytes], between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments one after the other, and how many each has; ``between``: those that begin and end at cuts."""
        order = np.argsort(~between, kind="stable")
        names, n = [names[k] for k in order.tolist()], int(between.sum())
        ends = np.cumsum(np.fromiter(map(len, names[:n]), np.int64, n))
        edges = [0, *(np.flatnonzero(np.diff(ends // JOINED_BYTES)) + 1).tolist(), n]
        parts, counts = [], []
        for at in range(0, len(edges) - 1, CALL):
            own = edges[at:at + CALL + 1]
            coded = self.tokenizer.encode_batch_fast([b"".join(names[a:b]).decode() for a, b in pairwise(own)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in coded), np.uint32)
            upto, until = np.cumsum(self.lengths[ids]), ends[own[0]:own[-1]] - (ends[own[0] - 1] if own[0] else 0)
            after = np.searchsorted(upto, until) + 1
            if len(after) and (after[-1] != len(ids) or (upto[after - 1] != until).any()):
                raise ValueError("tokens do not end where segments end")
            parts.append(ids)
            counts.append(np.diff(after, prepend=0))
        for name in names[n:]:
            parts.append(np.array(self.tokenizer.encode(name.decode(), add_special_tokens=False).ids, np.uint32))
            counts.append([len(parts[-1])])
        counts = np.concatenate(counts)
        ids, back = np.concatenate(parts), np.argsort(order)
        return ids[_ranges((np.cumsum(counts) - counts)[back], counts[back])], counts[back]
