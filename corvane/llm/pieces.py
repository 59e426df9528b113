"""SentencePiece encoding and decoding by batched numpy Viterbi (operator 2).

Equal-length words advance together, one end position at a time. At each end the substrings of every length are probed
by hash in the sorted keys of the pieces, each candidate gets a value, and the maximum's length is the backpointer.

Words beyond LONG characters are cut in stretches that advance together, see PieceModel._long_word().

- Unigram models: the value is the best score up to the candidate's start plus the piece's score, as usual. Words are
  scored one by one, so where two ways to split a word tie exactly, the library may choose the other one.
- BPE models don't maximise a sum of scores, so that sum gives other pieces than the library does. But each prefix's
  merges end in one definite last piece: the one that is compatible with the last piece before it, which means that
  merging the two pieces' text gives the two pieces again. The value is then the length of a compatible candidate,
  and the same lattice, probes, maxima and backpointers give exactly the library's pieces.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from heapq import heapify, heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, small_batches, table, text_slices

#: Default for the parameter model_file of encode(); read on the driver only, executors get its tables.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words kept with their ids in each Python worker: two generations of so many, none longer than KEPT_CHARS.
CACHE_WORDS, KEPT_CHARS = 40_000, 64
#: Bytes of text whose words are looked up together; the words are held as numbers, each distinct one once as text.
TOGETHER = 4_000_000
#: Rows of ids that are decoded together.
DECODE_ROWS = 64
#: Cells (words times places) of the lattice that advance together.
CELLS = 200_000
#: Words beyond so many characters are cut in stretches of STRETCH, which begin WARM places (or more, with long pieces) early.
LONG, STRETCH, WARM = 512, 256, 64
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5
#: Text comes in words: spaces but the last of a run, a space with what follows it, a line feed.
_WORDS = re.compile(r" ?[^ \n]+|\n| +(?= [^ \n])| +")
#: The same where no piece spans a letter or digit and a full stop or comma: nothing merges there, so words end there.
_FINER_WORDS = re.compile(r" ?\w+(?=[.,])| ?[^ \n]+|\n| +(?= [^ \n])| +")


class PieceModel:
    """Tables of a SentencePiece model: small, picklable, the same in driver and executors."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool, dummy_prefix: bool = True, byte_fallback: bool = True, unk_surface: str = " ⁇ "):
        self.bpe, self.dummy_prefix, self.n = bpe, dummy_prefix, len(pieces)
        self.unk = next((i for i, k in enumerate(kinds) if k == _UNKNOWN), 0)
        if any(k in (_USER, _UNUSED) for k in kinds):
            raise ValueError("models with user-defined or unused pieces aren't supported")
        normal = [i for i, k in enumerate(kinds) if k == _NORMAL]
        if any(SPACE in pieces[i][1:] and set(pieces[i]) != {SPACE} for i in normal) or any("\n" in pieces[i] for i in normal):
            raise ValueError("models with pieces that span words aren't supported")
        # What each id decodes to.
        self.surface = [b""] * self.n
        for i in normal:
            self.surface[i] = pieces[i].replace(SPACE, " ").encode()
        self.surface[self.unk] = unk_surface.encode()
        self.byte_id = np.full(256, -1, np.int64)
        for i, k in enumerate(kinds):
            if k == _BYTE:
                v = int(pieces[i][1:-1], 16)
                self.byte_id[v], self.surface[i] = i, bytes([v])
        if not byte_fallback:
            self.byte_id[:] = -1
        ids = {pieces[i]: i for i in normal}
        self.score = np.array(scores, np.float32)
        self.low = np.float32(min((scores[i] for i in normal), default=0.0) - 10.0)
        self.max_len = max((len(p) for p in ids), default=1)
        self._runs = {p: i for p, i in ids.items() if set(p) == {SPACE}}
        if bpe:
            self._merges(ids, scores)
        keep = [i for i in normal if not bpe or self.reachable[i]]
        keys = np.array([_hash(pieces[i]) for i in keep], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(keep, np.int64)[order]
        self.bounds = {n for n in map(len, ids)}
        self.probable = np.zeros(1 << 20, bool)  # the keys' first 20 bits: most substrings end here
        self.probable[self.keys >> np.uint64(44)] = True
        self.splitter = _WORDS if any(re.search(r"\w[.,]", p) for p in ids) else _FINER_WORDS
        self.single = {p: i for p, i in ids.items() if len(p) == 1}
        self._seams = self._joined = self._ranks = None

    def _merges(self, ids: dict[str, int], scores: list[float]) -> None:
        """Of each piece the two it was merged from, and which two pieces give which: by merging each piece's text.

        Runs of spaces tie in score; they are left to runs(), so only single spaces take part here.
        """
        order = sorted((i for p, i in ids.items() if len(p) > 1 and set(p) != {SPACE}), key=lambda i: (-scores[i], i))
        rank = {i: r + 1 for r, i in enumerate(order)}
        self.by_rank = [-1, *order]
        if len({scores[i] for i in order}) != len(order):
            raise ValueError("BPE pieces tie in score")
        self.rank = np.zeros(self.n, np.int64)
        self.left, self.right = np.arange(self.n), np.arange(self.n)
        self.reachable = np.zeros(self.n, bool)
        pair: dict[int, int] = {}
        for p, i in ids.items():
            if len(p) == 1:
                self.reachable[i] = True
            elif i in rank:
                self.rank[i] = rank[i]
                left, whole = _last_merge(p, ids, rank)
                if whole:
                    self.reachable[i] = True
                    self.left[i], self.right[i] = ids[p[:left]], ids[p[left:]]
        for p, i in ids.items():
            if i in rank:
                for at in range(1, len(p)):
                    a, b = ids.get(p[:at]), ids.get(p[at:])
                    if a is not None and b is not None:
                        pair[a << 20 | b] = rank[i]
        self.pair_keys = np.array(sorted(pair), np.int64)
        self.pair_rank = np.array([pair[k] for k in self.pair_keys.tolist()], np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == want, self.pair_rank[at], 1 << 40) if len(self.pair_keys) else np.full(len(a), 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_compatible() with a store of what was asked before, one pair in each slot."""
        if self._seams is None:
            self._seams = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        asked, said = self._seams
        pair = a << 20 | b
        slot = (pair.astype(np.uint64) * _BASE >> np.uint64(44)).astype(np.int64)
        out = said[slot]
        new = np.flatnonzero(asked[slot] != pair)
        if len(new):
            out[new] = self._compatible(a[new], b[new])
            # Pairs that share a slot: the last one stays, with its own answer.
            order = np.unique(slot[new][::-1], return_index=True)[1]
            last = new[len(new) - 1 - order]
            asked[slot[last]], said[slot[last]] = pair[last], out[last]
        return out

    def __getstate__(self):
        return self.__dict__ | {"_seams": None, "_joined": None, "_ranks": None}

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b gives a and b: undo the later of the two last merges at the seam, again
        and again, and see that no pair across the seam would have been merged before what was undone."""
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 39)
        while len(todo):
            bad = self._pair(a, b) < limit
            ok[todo[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb  # the left one was merged last
            sa, sb = ra == 0, rb == 0
            na, nb = self.right[a], self.left[b]
            undo_a, undo_b = first & ~sa, ~first & ~sb
            # A single character can't be undone: then the other one is, and two of them end it.
            undo_a |= ~first & sb & ~sa
            undo_b |= first & sa & ~sb
            limit = np.where(undo_a, ra, np.where(undo_b, rb + 1, limit))
            a, b = np.where(undo_a, na, a), np.where(undo_b, nb, b)
            go = ~bad & (undo_a | undo_b)
            a, b, limit, todo = a[go], b[go], limit[go], todo[go]
        return ok

    def runs(self, n: int) -> list[int]:
        """Ids of n spaces that no word has taken: equal scores merge from the left on."""
        if n <= 0:
            return []
        if not self.bpe:
            return np.frombuffer(self._words([SPACE * n])[0], "<i4").tolist()
        parts = [1] * n
        while True:
            best = next((k for k in range(len(parts) - 1) if SPACE * (parts[k] + parts[k + 1]) in self._runs), None)
            if best is None:
                break
            # All pairs tie, so the leftmost that can merge does; it stays leftmost until it can't any more.
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self._runs[SPACE * k] if SPACE * k in self._runs else self.unk for k in parts]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes of int32."""
        out = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, at in by.items():
            if length > LONG:
                for i in at:
                    out[i] = self._long_word(words[i])
            elif length:
                step = max(1, CELLS // length)
                for lo in range(0, len(at), step):
                    some = at[lo : lo + step]
                    for i, ids in zip(some, self._equal_length([words[i] for i in some], length)):
                        out[i] = ids
        return out

    def _equal_length(self, words: list[str], length: int) -> list[bytes]:
        n = len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        back, piece = self._lattice(chars)
        # Backpointers, all words together; rows in order of word, then of place.
        pos, rows, who, what, end = np.full(n, length), np.arange(n), [], [], []
        while len(rows):
            at = pos[rows]
            who.append(rows)
            what.append(piece[at, rows])
            end.append(at - 1)
            pos[rows] = at - back[at, rows]
            rows = rows[pos[rows] > 0]
        who, what, end = (np.concatenate(x[::-1]) for x in (who, what, end))
        order = np.argsort(who, kind="stable")
        what, cuts = what[order], (4 * np.r_[0, np.cumsum(np.bincount(who, minlength=n))]).tolist()
        flat = what.astype("<i4").tobytes()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.unique(who[order][what < 0]).tolist():
            a, b = cuts[i] // 4, cuts[i + 1] // 4
            out[i] = self._spelt(what[a:b].tolist(), [chr(chars[i, e]) for e in end[order[a:b]].tolist()])
        return out

    def _spelt(self, pieces: list[int], last: list[str]) -> bytes:
        """The ids of pieces, as bytes; -1 is a character, the piece's last, that is none."""
        ids: list[int] = []
        for k, char in zip(pieces, last):
            ids.extend([k] if k >= 0 else self._unknown(char, ids))
        return np.array(ids, "<i4").tobytes()

    def _lattice(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and number of the last piece at each end, for rows of characters that advance together; (length + 1, rows)."""
        n, length = chars.shape
        # Hash of a substring from the hashes of prefixes: H[j] - H[i] * base**(j - i).
        h, power = np.zeros((length + 1, n), np.uint64), _BASE ** np.arange(length + 1, dtype=np.uint64)
        for j in range(length):
            h[j + 1] = h[j] * _BASE + (chars[:, j].astype(np.uint64) + np.uint64(1))
        back, piece = np.ones((length + 1, n), np.int16), np.full((length + 1, n), -1, np.int32)
        best = np.full((length + 1, n), -np.inf, np.float32)  # the library adds up in single precision
        best[0] = 0.0
        for j in range(1, length + 1):
            value = np.full(n, -np.inf, np.float32)
            for size in range(1, min(j, self.max_len) + 1):
                if size not in self.bounds and size > 1:
                    continue
                key = h[j] - h[j - size] * power[size]
                hit = np.flatnonzero(self.probable[key >> np.uint64(44)])
                key = key[hit]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                same = self.keys[at] == key
                hit, at = hit[same], at[same]
                if not len(hit):
                    continue
                ids = self.ids[at]
                if self.bpe:
                    got = np.full(len(hit), size, np.float32)
                    before = piece[j - size][hit].astype(np.int64)
                    seam = np.flatnonzero(before >= 0) if size < j else np.zeros(0, np.int64)
                    got[seam[~self.compatible(before[seam], ids[seam])]] = -np.inf
                    got[best[j - size][hit] == -np.inf] = -np.inf
                else:
                    got = best[j - size][hit] + self.score[ids]
                more = (got >= value[hit]) & (got > -np.inf)  # of equal ones the longest piece, as in the library
                hit, ids, got = hit[more], ids[more], got[more]
                value[hit], back[j][hit], piece[j][hit] = got, size, ids
            if self.bpe:  # a character that is no piece merges with nothing: it is a seam by itself, with piece -1
                value[value == -np.inf] = 0.0
            else:
                missing = np.flatnonzero(~np.isin(h[j] - h[j - 1] * power[1], self.keys))
                got = best[j - 1][missing] + self.low
                more = got > value[missing]
                value[missing[more]], back[j][missing[more]], piece[j][missing[more]] = got[more], 1, -1
            best[j] = value
        return back, piece

    def _long_word(self, word: str) -> bytes:
        """A word beyond LONG characters: its stretches advance together as if they were words.

        BPE: what the last piece is at a place depends on the pieces at the max_len places before only. A stretch begins
        WARM places early, so by its own places it has mostly fallen in with the one before; that is seen from max_len
        places in a row where the two agree. If they don't (a text with a period, say), the word's pairs are merged from
        a heap instead, with the same result. Unigram scores are sums from the word's start, so there the candidates of
        all places are looked up together and only their maxima are taken place by place.
        """
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self._in_stretches(chars) if self.bpe else self._maxima(chars)
        pieces, ends = found if found else self._merged(word)
        return self._spelt(pieces, [word[e - 1] for e in ends])

    def _in_stretches(self, chars: np.ndarray) -> tuple[list[int], list[int]] | None:
        n, warm = len(chars), max(WARM, 4 * self.max_len)
        whole, starts = warm + STRETCH, list(range(0, max(1, n - warm), STRETCH))
        back, piece = np.ones(n + 1, np.int16), np.full(n + 1, -1, np.int32)
        full = [s for s in starts if s + whole <= n]
        groups = [full[i : i + CELLS // whole] for i in range(0, len(full), CELLS // whole)] + [[s] for s in starts if s + whole > n]
        for group in groups:
            size = min(whole, n - group[0])
            own_back, own_piece = self._lattice(np.stack([chars[s : s + size] for s in group]))
            for i, s in enumerate(group):
                trust = warm if s else 0
                seen = slice(s + trust - self.max_len + 1, s + trust + 1)
                if s and not (np.array_equal(piece[seen], own_piece[trust - self.max_len + 1 : trust + 1, i]) and np.array_equal(back[seen], own_back[trust - self.max_len + 1 : trust + 1, i])):
                    return None
                piece[s + trust : s + size + 1], back[s + trust : s + size + 1] = own_piece[trust:, i], own_back[trust:, i]
        return self._traced(back.tolist(), piece.tolist())

    @staticmethod
    def _traced(back: list[int], piece: list[int]) -> tuple[list[int], list[int]]:
        pieces, ends, at = [], [], len(back) - 1
        while at > 0:
            pieces.append(piece[at])
            ends.append(at)
            at -= back[at]
        return pieces[::-1], ends[::-1]

    def _maxima(self, chars: np.ndarray) -> tuple[list[int], list[int]]:
        n = len(chars)
        back, piece, best = [1] * (n + 1), [-1] * (n + 1), [0.0] * (n + 1)
        low, single, score = np.float32(self.low), np.float32, self.score.tolist()
        for lo in range(0, n, CELLS):
            hi = min(n, lo + CELLS)
            ends: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
            at = max(0, lo - self.max_len)
            h = np.zeros(hi - at + 1, np.uint64)
            for j, c in enumerate(chars[at:hi].tolist()):
                h[j + 1] = np.uint64((int(h[j]) * int(_BASE) + c + 1) & (2**64 - 1))
            for size in range(1, self.max_len + 1):
                if (size not in self.bounds and size > 1) or size > hi - at:
                    continue
                key = h[size:] - h[:-size] * _BASE ** np.uint64(size)
                where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                for k in np.flatnonzero(self.keys[where] == key).tolist():
                    end = at + k + size
                    if end > lo:
                        ends[end - lo - 1].append((size, int(self.ids[where[k]])))
            for j in range(lo + 1, hi + 1):
                top, some = None, ends[j - lo - 1]
                for size, k in some:  # shortest first: of equal values the longest piece
                    value = single(best[j - size]) + single(score[k])
                    if top is None or value >= top:
                        top, back[j], piece[j] = value, size, k
                if not some or some[0][0] > 1:
                    value = single(best[j - 1]) + low
                    if top is None or value > top:
                        top, back[j], piece[j] = value, 1, -1
                best[j] = float(top)
        return self._traced(back, piece)

    def _merged(self, word: str) -> tuple[list[int], list[int]]:
        """BPE by its definition: of all adjacent pairs the first in rank and place is merged, again and again."""
        n = len(word)
        ids, size = [self.single.get(c, -1) for c in word], [1] * n
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        if self._ranks is None:
            self._ranks = dict(zip(self.pair_keys.tolist(), self.pair_rank.tolist()))
        ranks, made = self._ranks, self.by_rank

        def pair(a: int, b: int) -> int:
            return ranks.get(a << 20 | b, 0) if a >= 0 and b >= 0 else 0

        heap = [(rank << 40) | i for i in range(n - 1) if (rank := pair(ids[i], ids[i + 1]))]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & ((1 << 40) - 1)
            j = after[i] if size[i] else n
            if j >= n or pair(ids[i], ids[j]) != top >> 40:
                continue
            ids[i], size[i], size[j] = made[top >> 40], size[i] + size[j], 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if rank := pair(ids[i], ids[k]):
                    heappush(heap, (rank << 40) | i)
            if (h := before[i]) >= 0 and (rank := pair(ids[h], ids[i])):
                heappush(heap, (rank << 40) | h)
        left = [i for i in range(n) if size[i]]
        return [ids[i] for i in left], [i + size[i] for i in left]

    def _unknown(self, char: str, before: list[int]) -> list[int]:
        raw = [int(self.byte_id[b]) for b in char.encode("utf-8", "surrogatepass")]
        if min(raw) >= 0:
            return raw
        return [] if before and before[-1] == self.unk else [self.unk]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids, rows cut at offsets: all surfaces are gathered at once."""
        if self._joined is None:
            size = np.array([len(x) for x in self.surface], np.int64)
            self._joined = np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum(size) - size, size
        every, start, size = self._joined
        flat = _gather(every, start, size, ids).tobytes()
        cuts = np.r_[0, np.cumsum(size[ids])][offsets].tolist()
        space = self.dummy_prefix
        return [flat[a + 1 : b] if space and flat[a : a + 1] == b" " and a < b else flat[a:b] for a, b in zip(cuts, cuts[1:])]


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of flat with those numbers, one after another."""
    n = size[which]
    ends = np.cumsum(n)
    return flat[np.repeat(start[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
    return h


def _last_merge(text: str, ids: dict[str, int], rank: dict[int, int]) -> tuple[int, bool]:
    """Where the last merge of text joins two parts, and whether text becomes one piece at all."""
    parts = list(text)
    at = 1
    while len(parts) > 1:
        best = min(((rank.get(ids.get(parts[k] + parts[k + 1], -1), 1 << 40), k) for k in range(len(parts) - 1)))
        if best[0] == 1 << 40:
            return 0, False
        at = len(parts[best[1]])
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return at, True


def load_model(model_file: str = MODEL_FILE) -> PieceModel:
    """Reads a model's pieces; the library isn't used beyond its file format."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model_file, "rb") as f:
        m.ParseFromString(f.read())
    norm = m.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models that leave the text as it is are supported")
    if m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return PieceModel([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type == 2, norm.add_dummy_prefix, m.trainer_spec.byte_fallback, m.trainer_spec.unk_surface)


class Encoder:
    """Encodes texts by words, each distinct word of a call once.

    Words of earlier calls are kept in two generations: a full young one becomes the old one, whose words come back
    when they are met again. So frequent words stay, and the store has a bound.
    """

    def __init__(self, model: PieceModel):
        self.model, self.young, self.old = model, {}, {}
        self.lone_space = model._runs.get(SPACE, -1)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        return self.model.splitter.findall((" " if self.model.dummy_prefix else "") + text)

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of each of the words, which are all different."""
        young, old = self.young, self.old
        out = [young.get(w) or old.get(w) for w in words]
        new = [i for i, ids in enumerate(out) if ids is None]
        plain = [i for i in new if words[i][-1] != " "]  # only runs of spaces end in one
        for i, ids in zip(plain, self.model._words([words[i].replace(" ", SPACE) for i in plain])):
            out[i] = ids
        for i in new:
            if words[i][-1] == " ":
                out[i] = np.array(self.model.runs(len(words[i])), "<i4").tobytes()
        for w, ids in zip(words, out):
            if len(w) <= KEPT_CHARS and w not in young:
                if len(young) >= CACHE_WORDS:
                    self.young, self.old = young, old = {}, young
                young[w] = ids
        return out

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text. Texts are read one by one; of their words only numbers are kept."""
        number, coded = defaultdict(count().__next__), []
        for t in texts:
            words = self.words(t or "")
            # Only a run of spaces can end the text in one or stand before another.
            spaced = bool(words) and (words[-1][-1] == " " or "  " in t or SPACE in t or t[0] == " " or " \n" in t)
            coded.append((np.fromiter(map(number.__getitem__, words), np.int32, len(words)), spaced))
        names = list(number)
        ids = self._look_up(names)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(size) - size
        return [self._runs_before_words([(names[k], ids[k]) for k in c.tolist()]) if spaced else _gather(flat, start, size, c) for c, spaced in coded]

    def _runs_before_words(self, words: list[tuple[str, bytes]]) -> np.ndarray:
        """A space that its word didn't take up merges with the spaces before it."""
        out, wait = [], 0
        lone = np.array([self.lone_space], "<i4").tobytes()
        for w, ids in words:
            if w[-1] == " ":
                wait += len(w)
                continue
            if wait and w[0] == " " and ids[:4] == lone:
                out += [np.array(self.model.runs(wait + 1), "<i4").tobytes(), ids[4:]]
            else:
                out += [np.array(self.model.runs(wait), "<i4").tobytes(), ids]
            wait = 0
        out.append(np.array(self.model.runs(wait), "<i4").tobytes())
        return np.frombuffer(b"".join(out), "<i4")


_workers: dict[int, Encoder] = {}


def _encode(shared, with_decoded: bool):
    def run(batches):
        if shared.value is not None and id(shared) not in _workers:
            _workers.clear()
            _workers[id(shared)] = Encoder(shared.value)
        enc = _workers[id(shared)]
        for held in joined(batches, TOGETHER):
            got = iter(enc.encode(x.as_py() for b in held for x in b.column("text")))
            for b in text_slices(held):
                part = list(islice(got, b.num_rows))
                offsets = np.r_[0, np.cumsum([len(x) for x in part])].astype(np.int32)
                flat = np.concatenate([*part, np.zeros(0, "<i4")]).astype(np.int32)
                others = [c for c in b.schema.names if c != "text"]
                cols = [b.column(c) for c in others] + [pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                names = others + ["n_tokens", "ids"]
                if with_decoded:
                    again = enc.model.decode_bytes(flat, offsets)
                    cols.append(pa.array([x == (t or "").replace(SPACE, " ").encode() for x, t in zip(again, b.column("text").to_pylist())]))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL_FILE, check: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (array of int), with check also round_trip.

    The ids are those of the SentencePiece library. Null and empty texts have no ids; very long texts are taken whole. U+2581 is the model's space,
    so it decodes to a space. Repeated rows and null ids are rows like any other; other columns are ignored. No
    shuffle; the model's tables (a few MB, fixed by its file) are broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_model(model_file))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["_id"]
    out = rows.mapInArrow(_encode(shared, check), f"_id {kind}, n_tokens long, ids array<int>" + (", round_trip boolean" if check else ""))
    return out.withColumnRenamed("_id", id_col)


def _decode(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            ids = b.column("ids")
            n = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
            offsets = np.r_[0, np.cumsum(n)]
            for lo in range(0, b.num_rows, DECODE_ROWS):
                hi = min(lo + DECODE_ROWS, b.num_rows)
                flat = np.asarray(ids.slice(lo, hi - lo).flatten(), np.int64)
                texts = [x.decode("utf-8", "replace") for x in model.decode_bytes(flat, offsets[lo : hi + 1] - offsets[lo])]
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(lo, hi - lo), pa.array(texts, pa.string())], ["_id", "text"])

    return run


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """One row per row: id, text. Null ids decode to the empty text. Repeated rows and null ids of rows stay as they are; lists
    of ids are decoded whole, DECODE_ROWS of them together."""
    spark = rows.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_model(model_file))
    own = rows.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = dict(own.dtypes)["_id"]
    return own.mapInArrow(_decode(shared), f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents' ids, each text decoded again and compared."""
    return encode(table(spark, sf_dir, "documents"), check=True)
