"""Evaluation texts that leaked into training texts, wholly or in part, damaged as scanned pages are.

1. Each item's words make n-grams of SEED words. One pass over all documents counts in how many each n-gram stands
   alone, that is without LONG successive words of an item within SPREAD words. So an n-gram isn't taken for a common
   one because the passage it belongs to is often reprinted. Of a text with many equal copies each copy counts as a part.
2. The rare ones are seeds: those alone in fewer than exp(-COMMON) (1.8 %) of the documents, weighted by how much rarer they
   are, in logarithms up to MOST. Where the seeds of a passage's length of an item weigh less than ENOUGH together (as it is reprinted very
   often, or the corpus is small), the rarest n-grams there are made seeds of weight RAISED, however common they are. So a passage
   that stands in any share of the documents is found. A document and an item that share seeds of a total weight of EVIDENCE within
   SPREAD words of the item (two or three, usually) are a candidate pair. So are those that share LONG successive words.
3. A Smith-Waterman alignment of words scores each candidate. Words match if they are equal or share enough
   letter pairs (misread letters, halves of words broken at a line end). Lines may be skipped whole, at a small
   cost: adverts, and lines of another column. The item's words that the best alignment runs over, from its first to its last, are the passage.
   If too few of them matched, the longest part of it that is matched well enough is, and else one of the next best alignment,
   down to a score of WEAK.

Long items are handled in pieces and long documents in stretches that overlap by more than a passage; what was found in several of them is put
together again. Up to a bound the items are sent to the tasks, and nothing but the counts of their n-grams goes through a shuffle; beyond
it their n-grams are a table that is joined with the documents' (leakjoin), by the same rules.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED, EVIDENCE, SPREAD = 3, 12.0, 40
#: The weight of a seed: the logarithm of how rare it is, less COMMON, at most MOST; what the seeds of a passage weigh at least, and the weight of those that are raised for that.
COMMON, MOST, ENOUGH, RAISED = 4.0, 6.0, 48.0, 4.0
#: So many successive words of an item make a candidate whatever their frequency.
LONG = 8
#: The most texts of which equal copies are counted together.
COPIED = 1_000
#: The most items, and characters of items, that are sent to the tasks; more are joined with the documents (see leakjoin).
ITEM_BLOCK, BLOCK_CHARACTERS = 20_000, 12_000_000
#: Longer items are handled as pieces of so many words, which share PIECE_SHARED words with the next; both are longer if longer passages are asked for.
PIECE, PIECE_SHARED = 400, 100
#: Of the alignment: a matched word, one that doesn't match, an item's word that is left out, skipping lines, and each line skipped; least share of letter pairs.
MATCH, MISS, LEFT_OUT, SKIP, LINE, ALIKE = 1.0, -1.0, -0.8, -1.0, -0.1, 0.5
#: Longer documents are aligned in stretches of about four times as many words as they share with the next (more if longer passages are asked for), and lines of over LINE_WORDS words are cut.
STRETCH_SHARED, LINE_WORDS = 250, 50
#: The least score of an alignment in which a passage is looked for; 24 words in lines of four with other lines in between have some 11.
WEAK = 9.0
#: The alignment keeps positions in pieces, four times as long as a passage, in 16 bits.
MOST_ASKED = 16_000
#: Pairs that are aligned side by side; texts that are looked at side by side.
TOGETHER, TEXTS = 96, 1_000

_BROKEN = re.compile(r"[-¬=~­‐‑‒–]+[^\S\n]*\n\s*")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case, those broken at a line end with a mark joined."""
    return _WORD.findall(_BROKEN.sub("", unicodedata.normalize("NFKC", text)).casefold()) if text else []


def lines(text: str) -> list[list[str]]:
    """The words of each line that has any, broken ones left as they are."""
    plain = unicodedata.normalize("NFKC", text).casefold().replace("\xad", "")
    return [w for x in plain.split("\n") if (w := _WORD.findall(x))]


def stands_alone(owner: np.ndarray, at: np.ndarray, long_at: np.ndarray) -> np.ndarray:
    """Whether each n-gram that begins at `at` is without a long one within SPREAD words. owner: the text of each word."""
    # the first long one that isn't too far before; texts are set apart so that none reaches into the next
    apart = 2 * SPREAD * owner
    begin, marks = at + apart[at], long_at + apart[long_at]
    k = np.searchsorted(marks, begin - (LONG - SEED) - SPREAD)
    return np.append(marks, 1 << 62)[k] > begin + SPREAD


def weights(share: np.ndarray, least: int) -> np.ndarray:
    """The weights of the n-grams of one piece, in their order, by the share of the documents in which each stands alone. In every passage of `least` words the rarest are raised until they weigh ENOUGH together."""
    with np.errstate(divide="ignore"):
        weight = np.clip(-np.log(share) - COMMON, 0, MOST)
    size = least - SEED + 1
    for k in range(len(weight) - size + 1):
        missing = ENOUGH - weight[k : k + size].sum()
        if missing > 0:
            for r in (k + np.argsort(share[k : k + size], kind="stable")).tolist():
                if weight[r] < RAISED and missing > 0:
                    missing -= RAISED - weight[r]
                    weight[r] = RAISED
    return weight


class Items:
    """Some items: word ids, n-grams as numbers, and where they stand."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = 24):
        shared = max(PIECE_SHARED, least)
        self.size = max(PIECE, 4 * shared)
        step = self.size - shared
        pieces = [(i, k, w[k : k + self.size]) for i, t in items for w in [words(t)] for k in range(0, max(1, len(w) - shared), step)]
        self.ids = [i for i, _, _ in pieces]
        self.offsets = [k for _, k, _ in pieces]
        self.words = [w for _, _, w in pieces]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(self.words)))}
        self.base = len(self.vocabulary) + 1
        self.known, self.at = self._places(SEED)
        self.known_long, self.at_long = self._places(LONG)

    def _places(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams, sorted, and the index of the n-gram, the piece and the position of each of their places, in that order."""
        rows = [np.zeros((0, 3), np.int64)]
        for k, w in enumerate(self.words):
            code, at = self.grams(np.fromiter(map(self.vocabulary.__getitem__, w), np.int64, len(w)), size)
            rows.append(np.stack([code, np.full(len(code), k), at], axis=1))
        rows = np.concatenate(rows)
        known, rows[:, 0] = np.unique(rows[:, 0], return_inverse=True)
        return known, rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]

    def grams(self, ids: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-grams of a sequence of word ids (-1: a word that no item has) and their positions. Numbers of long ones are hashes."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, good = np.zeros(n, np.int64), np.ones(n, bool)
        factor = self.base if size <= SEED else 6_364_136_223_846_793_005
        for k in range(size):
            part = ids[k : k + n]
            code = code * factor + part
            good &= part >= 0
        at = np.flatnonzero(good)
        return code[at], at

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of the texts, -1 for those that no item has, and the text of each."""
        all_words = [words(t) for t in texts]
        sizes = np.fromiter(map(len, all_words), np.int64, len(texts))
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(all_words), repeat(-1)), np.int64, int(sizes.sum()))
        return ids, np.repeat(np.arange(len(texts)), sizes)

    def hits(self, ids: np.ndarray, owner: np.ndarray, size: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the texts have n-grams of items, and which."""
        code, at = self.grams(ids, size)
        same = owner[at] == owner[at + size - 1]
        code, at = code[same], at[same]
        k = np.searchsorted(known, code)
        k[k == len(known)] = 0
        hit = known[k] == code if len(known) else np.zeros(len(code), bool)
        return at[hit], k[hit]

    def alone(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams that stand alone: the text's index, the n-gram's index."""
        ids, owner = self.ids_of(texts)
        at, gram = self.hits(ids, owner, SEED, self.known)
        long_at, _ = self.hits(ids, owner, LONG, self.known_long)
        alone = stands_alone(owner, at, long_at)
        return owner[at[alone]], gram[alone]


@lru_cache(200_000)
def _letter_pairs(word: str) -> tuple[bytes, int]:
    """The set of a word's letter pairs as the bits of four numbers, and their number."""
    marked = f"\x02{word}\x03"
    pairs = {(ord(a) * 31 + ord(b) * 7) % 251 for a, b in zip(marked, marked[1:])}
    return sum(1 << p for p in pairs).to_bytes(32, "little"), len(pairs)


def _masks(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letter pairs of the distinct words, their numbers, and which of these each word is."""
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    masks, sizes = zip(*map(_letter_pairs, index))
    return np.frombuffer(b"".join(masks), "<u8").reshape(-1, 4), np.array(sizes, np.int16), np.fromiter(map(index.__getitem__, words), np.intp, len(words))


def _alike(page: tuple[np.ndarray, ...], item: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each word of a page matches each word of an item, both as _masks."""
    (a, sizes, which), (b, own_sizes, own_which) = page, item
    common = np.bitwise_count(a[:, None, 0] & b[None, :, 0])
    for k in range(1, 4):
        common += np.bitwise_count(a[:, None, k] & b[None, :, k])
    like = 2 * common.astype(np.int16) >= ALIKE * (sizes[:, None] + own_sizes[None, :])
    return like.take(which, axis=0).take(own_which, axis=1)


def align(pairs: list[tuple[list[str], list[list[str]]]], alike: list[np.ndarray] | None = None) -> list[tuple[float, int, int, int, int]]:
    """score, first and last word of the item, and matched words of the best local alignment of each (item, lines of a page); the most matched words of any alignment that scores WEAK.

    All pairs are aligned side by side. A state is one number: the score in the upper half, then what the first
    word leaves to the highest position, then the matched words; so the larger of two is the better one. Short items need numbers of 32 bits only.
    alike: which words match, if known.
    """
    alike = alike or [_alike(_masks(list(chain.from_iterable(page))), _masks(item)) for item, page in pairs]
    turn = sorted(range(len(pairs)), key=lambda i: -len(alike[i]))  # the longest first: those that still run are the first rows
    n, wide, long = len(pairs), max(len(item) for item, _ in pairs), len(alike[turn[0]])
    bits, kind, never = (9, np.int32, -(1 << 30)) if wide < 400 else (16, np.int64, -(1 << 50))
    unit, high = 1 << 2 * bits, (1 << bits) - 1
    delta = np.full((long, n, wide), int(MISS * 10) * unit, kind)
    starting: list[list[int]] = [[] for _ in range(long)]
    ending: list[list[int]] = [[] for _ in range(long)]
    running = np.zeros(long, np.int64)
    for k, i in enumerate(turn):
        d, at = alike[i], 0
        delta[: len(d), k, : d.shape[1]][d] = int(MATCH * 10) * unit + 1
        running[: len(d)] += 1
        for x in pairs[i][1]:
            starting[at].append(k)
            at += len(x)
            ending[at - 1].append(k)
    begin = np.broadcast_to((high - np.arange(wide + 1, dtype=kind)) << bits, (n, wide + 1))
    state, best = begin.copy(), begin.copy()
    held, step, part, most = np.full_like(state, never), np.empty_like(state), np.empty((n, wide), kind), np.zeros(n, kind)
    miss, left_out, skip, line, weak = (kind(int(x * 10) * unit) for x in (MISS, LEFT_OUT, SKIP, LINE, WEAK - 4))
    for k, m in enumerate(running.tolist()):
        if at := starting[k]:
            state[at] = np.maximum(state[at], held[at])
        now, new, tmp = state[:m], step[:m], part[:m]
        np.add(now, miss, out=new)  # a word of the page that the item doesn't have
        np.add(now[:, :-1], delta[k, :m], out=tmp)
        np.maximum(new[:, 1:], tmp, out=new[:, 1:])
        for _ in range(2):  # words of the item that the page doesn't have
            np.add(new[:, :-1], left_out, out=tmp)
            np.maximum(new[:, 1:], tmp, out=new[:, 1:])
        np.maximum(new, begin[:m], out=new)
        state, step = step, state
        np.maximum(best[:m], new, out=best[:m])
        if at := ending[k]:
            held[at] = np.maximum(held[at] + line, new[at] + skip)
        if k % 4 == 3 or k == long - 1 or m > running[k + 1]:  # an alignment that scores WEAK loses less than four until then
            most[:m] = np.maximum(most[:m], np.where(new >= weak, new & high, 0).max(axis=1))
    last = (best >> 2 * bits).argmax(axis=1)
    top = best[np.arange(n), last]
    most = np.maximum(most, top & high)
    back = np.argsort(turn)
    top, last, most = top[back], last[back], most[back]
    return [(s / 10, high - (f & high), e - 1, h, m) for s, f, e, h, m in zip((top >> 2 * bits).tolist(), (top >> bits).tolist(), last.tolist(), (top & high).tolist(), most.tolist())]


def paths(item: list[str], page: list[list[str]]) -> Iterator[tuple[float, list[tuple[int, bool]]]]:
    """Score and path of the alignments of one pair, the best first, down to WEAK; none takes a match that one before has. A path is the item's words it runs over, and whether each matched."""
    like = _alike(_masks(list(chain.from_iterable(page))), _masks(item))
    ends = np.cumsum([len(x) for x in page]) - 1
    starts = {0, *(ends[:-1] + 1).tolist()}
    match, miss, left_out, skip, line = (int(x * 10) for x in (MATCH, MISS, LEFT_OUT, SKIP, LINE))
    long, wide = like.shape
    last_of_line = set(ends.tolist())
    while True:
        # base: the state before each word of the page; source: the line's end that it is taken from
        base, state = np.zeros((long + 1, wide + 1), np.int64), np.zeros((long + 1, wide + 1), np.int64)
        source = np.tile(np.arange(long + 1)[:, None], wide + 1)
        held, held_at = np.full(wide + 1, -(1 << 40)), np.zeros(wide + 1, np.int64)
        for k in range(long):
            base[k] = state[k]
            if k in starts and (take := held > base[k]).any():
                base[k][take], source[k][take] = held[take], held_at[take]
            step = base[k] + miss
            step[1:] = np.maximum(step[1:], base[k, :-1] + np.where(like[k], match, miss))
            for _ in range(2):
                step[1:] = np.maximum(step[1:], step[:-1] + left_out)
            state[k + 1] = np.maximum(step, 0)
            if k in last_of_line:
                held += line
                new = state[k + 1] + skip
                held_at[new > held] = k + 1
                held = np.maximum(held, new)
        k, j = divmod(int(state.argmax()), wide + 1)
        score, path = state[k, j] / 10, []
        if score < WEAK:
            return
        while k and state[k, j] > 0:
            now, row = state[k, j], base[k - 1]
            hit = j > 0 and bool(like[k - 1, j - 1])
            if j and now == row[j - 1] + (match if hit else miss):
                path.append((j - 1, hit))
                like[k - 1, j - 1] = False
                j -= 1
                k = int(source[k - 1, j])
            elif now == row[j] + miss:
                k = int(source[k - 1, j])
            else:
                path.append((j - 1, False))
                j -= 1
        yield score, path[::-1]


def passage(path: list[tuple[int, bool]], least: int, least_matched: float) -> tuple[int, int, int] | None:
    """First and last word of the item and matched words of the longest part of a path that has at least `least` words, that share of them matched."""
    matched = np.concatenate([[0], np.cumsum([m for _, m in path])])
    n = len(path)
    for size in range(n, least - 1, -1):
        hits = matched[size:] - matched[: n + 1 - size]
        if hits.max() >= least_matched * size:
            k = int(hits.argmax())
            return path[k][0], path[k + size - 1][0], int(hits[k])
    return None


def _spread_out(starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of groups that lie one after another from starts[i] to starts[i + 1]: the place in index of the group, and the row."""
    sizes = starts[index + 1] - starts[index]
    owner = np.repeat(np.arange(len(index)), sizes)
    return owner, starts[index][owner] + np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]


class Matcher:
    """The weights of a block of items' n-grams, given the share of the documents in which each stands alone."""

    def __init__(self, items: Items, share: np.ndarray, least: int = 24):
        self.items, self.least, self.masks = items, least, {}
        self.starts, self.starts_long = (np.searchsorted(at[:, 0], np.arange(len(known) + 1)) for at, known in ((items.at, items.known), (items.at_long, items.known_long)))
        self.weight = np.zeros(len(items.at))  # of each place
        order = np.lexsort((items.at[:, 2], items.at[:, 1]))
        ends = np.searchsorted(items.at[order, 1], np.arange(len(items.words) + 1))
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            self.weight[order[a:b]] = weights(share[items.at[order[a:b], 0]], least)
        self.used = np.add.reduceat(self.weight, self.starts[:-1]) > 0 if len(items.known) else np.zeros(0, bool)

    def candidates(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Index of a text, index of a piece of an item; sorted."""
        if not self.items.words:
            return []
        ids, owner = self.items.ids_of(texts)
        pieces = len(self.items.words)
        at, long = self.items.hits(ids, owner, LONG, self.items.known_long)
        hit, row = _spread_out(self.starts_long, long)
        sure = owner[at[hit]] * pieces + self.items.at_long[row, 1]
        at, gram = self.items.hits(ids, owner, SEED, self.items.known)
        at, gram = at[self.used[gram]], gram[self.used[gram]]
        hit, row = _spread_out(self.starts, gram)
        hit, row = hit[self.weight[row] > 0], row[self.weight[row] > 0]
        # a position counts once; those of one pair lie together, too far from the next pair's to be in one window with them
        apart = self.items.size + SPREAD + 1
        place, first = np.unique((owner[at[hit]] * pieces + self.items.at[row, 1]) * apart + self.items.at[row, 2], return_index=True)
        total = np.concatenate([[0.0], np.cumsum(self.weight[row[first]])])
        enough = total[1:] - total[np.searchsorted(place, place - SPREAD)] >= EVIDENCE - 1e-6
        pairs = np.unique(np.concatenate([sure, place[enough] // apart]))
        return list(zip((pairs // pieces).tolist(), (pairs % pieces).tolist()))

    def matches(self, texts: list[str | None], least_matched: float) -> Iterator[tuple[int, int, float, int, int]]:
        """text, item's id, score, words, matched words of every text and item with a passage of enough words, that share of them matched."""
        for start in range(0, len(texts), TEXTS):
            for t, *rest in self._matches(texts[start : start + TEXTS], least_matched):
                yield start + t, *rest

    def _masks_of(self, k: int) -> tuple[np.ndarray, ...]:
        if k not in self.masks:
            self.masks[k] = _masks(self.items.words[k])
        return self.masks[k]

    def _matches(self, texts: list[str | None], least_matched: float) -> Iterator[tuple[int, int, float, int, int]]:
        held: list[tuple[int, int, list[list[str]], tuple[np.ndarray, ...]]] = []
        found: dict[tuple[int, int], list[tuple[float, int, int, int, int, list[list[str]]]]] = {}
        failed: list[tuple[int, int, list[list[str]]]] = []
        least, ids, item_words = self.least, self.items.ids, self.items.words
        now, stretches = -1, []
        for t, k in self.candidates(texts):
            if t != now:
                now, stretches = t, [(page, _masks(list(chain.from_iterable(page)))) for page in _stretches(lines(texts[t]), max(STRETCH_SHARED, 2 * least))]
            held += [(t, k, page, masks) for page, masks in stretches]
        # pairs of like sizes side by side
        held.sort(key=lambda x: (len(item_words[x[1]]) // 32, sum(map(len, x[2]))))
        for i in range(0, len(held), TOGETHER):
            part = held[i : i + TOGETHER]
            for (t, k, page, _), (score, first, last, hits, most) in zip(part, align([(item_words[k], page) for _, k, page, _ in part], [_alike(masks, self._masks_of(k)) for _, k, _, masks in part])):
                if last - first + 1 >= least and hits >= least_matched * (last - first + 1):
                    found.setdefault((t, ids[k]), []).append((score, k, first, last, hits, page))
                elif most >= least_matched * least:
                    failed.append((t, k, page))
        for t, k, page in failed:
            if (t, ids[k]) not in found or len(self.items.words[k]) == self.items.size:
                for score, path in paths(item_words[k], page):
                    if part := passage(path, least, least_matched):
                        found.setdefault((t, ids[k]), []).append((score, k, *part, page))
                        break
        for (t, item), parts in found.items():
            score, _, first, last, hits, _ = max(parts, key=lambda x: x[:5])
            size = last - first + 1
            if len(parts) > 1:
                size, hits = self._joined(parts, least_matched)
            yield t, item, score, size, hits

    def _joined(self, parts: list[tuple[float, int, int, int, int, list[list[str]]]], least_matched: float) -> tuple[int, int]:
        """Words and matched words of the longest passage of one item that its parts in several pieces and stretches make up: those that share words are one."""
        seen: dict[int, bool] = {}
        runs = []
        for _, k, *_, page in parts:
            for _, path in paths(self.items.words[k], page):
                if part := passage(path, self.least, least_matched):
                    inside = [(self.items.offsets[k] + j, hit) for j, hit in path if part[0] <= j <= part[1]]
                    runs.append((inside[0][0], inside[-1][0]))
                    for j, hit in inside:
                        seen[j] = seen.get(j, False) or hit
                    break
        best, begin, end = (0, 0), None, None
        for a, b in [*sorted(runs), (1 << 60, 1 << 60)]:
            if begin is not None and a > end + 1:
                best = max(best, (end - begin + 1, sum(seen.get(j, False) for j in range(begin, end + 1))))
                begin = None
            begin, end = (a, b) if begin is None else (begin, max(end, b))
        return best


def _stretches(page: list[list[str]], shared: int = STRETCH_SHARED) -> list[list[list[str]]]:
    """The lines of a page in stretches of about four times `shared` words, of which each begins with the last quarter of the lines of the one before, or more so that `shared` words are shared."""
    out, part, size, fresh = [], [], 0, False
    for x in (x[i : i + LINE_WORDS] for x in page for i in range(0, len(x), LINE_WORDS)):
        part.append(x)
        size += len(x)
        fresh = True
        if size >= 4 * shared:
            out.append(part)
            keep, size = len(part) // 4, 0
            keep = max(keep, next(n for n, x in enumerate(reversed(part), 1) if (size := size + len(x)) >= shared))
            part, fresh = part[-keep:], False
            size = sum(map(len, part))
    return [*out, part] if fresh else out


def leaked(documents: DataFrame, items: DataFrame, least: int = 24, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least_matched: float = 0.85) -> DataFrame:
    """key, item, words, matched, score: each document and item of which it reproduces at least `least` successive words.

    words is the length of the longest passage in the item, matched how many of its words were recognised, score that of the best alignment (of a piece and a
    stretch, for long items and documents). least may be up to MOST_ASKED. The document frequencies are counted in jobs of their own when this is called. Null and empty texts give no rows. An item
    of fewer words than `least` gives none. Repeated keys give a row each.
    """
    spark = documents.sparkSession
    given = documents.select(F.col(key), F.col(text).alias("_text"))
    kinds = (given.schema[0].dataType, items.schema[item].dataType)
    schema = T.StructType([T.StructField(key, kinds[0]), T.StructField(item, kinds[1]), T.StructField("words", T.IntegerType()), T.StructField("matched", T.IntegerType()), T.StructField("score", T.DoubleType())])
    if least > MOST_ASKED:
        raise ValueError(f"passages of up to {MOST_ASKED} words can be asked for")

    def against(block: list[tuple[int, str | None]]) -> DataFrame:
        own = spark.sparkContext.broadcast(Items(block, least))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(own.value.known) + 1)  # the last counts all documents
            for b in batches:
                n[-1] += len(b)
                part = np.array([1 / copies.get(h, 1) for h in b.column(1).to_pylist()])
                owner, gram = own.value.alone(b.column(0).to_pylist())
                once = np.unique(owner * len(n) + gram)
                n += np.bincount(once % len(n), part[once // len(n)], len(n)) if len(once) else 0
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["gram", "n"])

        frequency = np.zeros(len(own.value.known) + 1)
        for g, n in given.select("_text", F.xxhash64("_text")).mapInArrow(count, "gram bigint, n double").groupBy("gram").agg(F.sum("n")).toLocalIterator():
            frequency[g] = n
        matcher = spark.sparkContext.broadcast(Matcher(own.value, frequency[:-1] / max(1.0, frequency[-1]), least))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(matcher.value.matches(b.column(1).to_pylist(), least_matched))
                t, i, score, n, hits = zip(*got) if got else [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t, pa.int64())), pa.array(i, kind), pa.array(n, pa.int32()), pa.array(hits, pa.int32()), pa.array(score, pa.float64())], names=schema.names)

        return given.mapInArrow(match, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(kinds[1])
    same = given.groupBy(F.xxhash64("_text").alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = {h: n for h, n in same.orderBy(F.desc("n"), "hash").limit(COPIED).collect()}
    few = items.select(item, item_text)
    n, size = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()
    if n <= ITEM_BLOCK and size <= BLOCK_CHARACTERS:
        return against([(r[0], r[1]) for r in few.collect()])
    from . import leakjoin

    return leakjoin.leaked(given, few, schema, copies, least, least_matched)
