"""Evaluation texts that appear, fully or partly, in a corpus.

Method: an FM-index per shard of the corpus. Each task takes its documents in shards of SHARD_CHARS characters, maps the words that
occur in test items to numbers (all other words are gaps), sorts the suffixes, and keeps the Burrows-Wheeler transform in a
wavelet matrix with sampled suffix positions. All phrases of the test items are searched backward at once, counted, and located. Rare
phrases give diagonals (same document, same part of an item, same offset); a phrase that stands in many places of both sides gives one only
together with two more words at the same distance in both (``paired``), so that stock phrases are not multiplied out. Diagonals are then verified word by word.

A document leaks an item if it holds, of one part of it, at least RUN consecutive words, or at least NEAR consecutive words of
which at most one in ODD is replaced; of an item in Chinese, ZH_RUN consecutive characters. Phrases of four words are enough to lose
none: with m replaced words in L >= 20, m <= L / 6, a diagonal has at least L - 4 m - 3 >= 5 phrases that match.

Only words count: case, punctuation, mark-up, underscores and line breaks do not. Sentences that open several texts which
differ afterwards (standing instructions) belong to no item; shared sentences elsewhere do. Test items are the stated query set; they reach the
driver and the tasks in blocks of ITEM_CHARS characters, and each shard is indexed once for all blocks.

Defined results: null or blank texts leak nothing; null or short items are never leaked; repeated rows give one case; no items
or no documents give no rows; a text longer than a shard is a shard of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgemill.session import cut, spread

RUN, NEAR, ODD, ZH_RUN, PHRASE, SHARED = 12, 20, 6, 20, 4, 3
SHARD_CHARS, ITEM_CHARS = 3_000_000, 20_000_000
#: A phrase is multiplied out only if it occurs at most so often in the shard, or has at most so many places in the items.
COMMON = 256
#: Words that a passage need not exceed to be found: of a longer one that is within the threshold, one half is too.
REACH = 2 * NEAR
WORD = re.compile(r"[^\W_]+")
CHAR = re.compile(r"[^\W_]")
HAN = re.compile(r"[㐀-鿿]")
SENTENCE_END = r"(?<=[.!?])\s+|(?<=[。！？])"


def fold(text: str) -> str:
    """Lower case and one form of each character, of the same length, so that offsets hold."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])
    if low.isascii():
        return low
    return "".join(n if len(n) == 1 else c for c in low for n in [unicodedata.normalize("NFKC", c)])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling; only what is still tied is sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.r_[True, s[order][1:] != s[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while True:
        size = np.diff(np.r_[np.flatnonzero(new), n])
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        pos = order[at]
        follow = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)], -1)
        by = np.lexsort((follow, rank[pos]))
        pos, follow = pos[by], follow[by]
        group = rank[pos]
        order[at] = pos
        cut = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        new[at] = cut
        rank[pos] = at[np.maximum.accumulate(np.where(cut, np.arange(len(at)), 0))]
        k *= 2


class FmIndex:
    """Burrows-Wheeler transform of a sequence of numbers in a wavelet matrix, with every ``step``-th position sampled."""

    def __init__(self, s: np.ndarray, sigma: int, step: int = 8) -> None:
        s, sigma = np.r_[s + 1, 0], sigma + 1  # an end that is smaller than all symbols and occurs once
        order = suffix_array(s)
        self.n, self.levels = len(s), max(1, int(sigma - 1).bit_length())
        last = s[order - 1]  # of the first position, the last symbol
        self.ones, self.zeros = [], []
        row = last
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.less = np.r_[0, np.cumsum(np.bincount(s, minlength=sigma))][:sigma]
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))
        sampled = order % step == 0
        self.sampled, self.sample_rank, self.samples = sampled, np.cumsum(sampled) - 1, order[sampled]

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            one = ones[i]
            i = np.where((c >> level) & 1, zeros + one, i - one)
        return i

    def ranks(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before row i of the transform."""
        return self._walk(c, i) - self.base[c]

    def backward(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one position earlier."""
        i, c = rows, np.zeros(len(rows), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[i]
            bit = ones[i + 1] - one
            c = c << 1 | bit
            i = np.where(bit, zeros + one, i - one)
        return self.less[c] + i - self.base[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows of each phrase (rows of a matrix)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[:, j] + 1
            low, high = self.less[c] + self.ranks(c, low), self.less[c] + self.ranks(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in ``rows``, by walking back to a sampled one."""
        at, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            hit = self.sampled[at[left]]
            done = left[hit]
            out[done] = self.samples[self.sample_rank[at[done]]] + steps
            left = left[~hit]
            at[left] = self.backward(at[left])
            steps += 1
        return out % self.n


@dataclass
class Phrases:
    """Of one kind of token and one block of items: their parts and the phrases of these. Tokens are numbered alike in all blocks."""

    items: np.ndarray  # item of each part
    parts: list[np.ndarray]
    grams: np.ndarray  # distinct phrases
    part: np.ndarray  # for each place of a phrase: its part, offset; sorted by phrase
    offset: np.ndarray
    first: np.ndarray  # of each phrase, its first place; one more at the end


def phrases(parts: list[tuple[int, list[str]]], size: int, ids: dict[str, int]) -> Phrases | None:
    """``ids`` takes up the tokens of the parts."""
    parts = [p for p in parts if len(p[1]) >= size]
    if not parts:
        return None
    coded = [np.array([ids.setdefault(t, len(ids) + 1) for t in tokens], np.int64) for _, tokens in parts]
    grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, size) for c in coded])
    part = np.concatenate([np.full(len(c) - size + 1, k) for k, c in enumerate(coded)])
    offset = np.concatenate([np.arange(len(c) - size + 1) for c in coded])
    distinct, which = np.unique(grams, axis=0, return_inverse=True)
    by = np.argsort(which.ravel(), kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(which.ravel()))]
    return Phrases(np.array([p[0] for p in parts]), coded, distinct, part[by], offset[by], first)


def item_parts(rows: list) -> tuple[list, list]:
    """Word parts and character parts of test items, without the leading sentences that are no part of them."""
    words, chars = [], []
    for r in rows:
        for text, lead in ((r["question"], r["question_lead"]), (r["text"], r["text_lead"])):
            joined = fold(" ".join(re.split(SENTENCE_END, text or "")[lead:]))
            zh = (r["lang"] or "").lower().startswith("zh") or len(HAN.findall(joined)) > len(WORD.findall(joined))
            (chars if zh else words).append((r["item_id"], (CHAR if zh else WORD).findall(joined)))
    return words, chars


def openings(text: str | None) -> list[tuple[int, str, str]]:
    """Every way to part a text after k of its sentences: k, digest of the first part, digest of the rest; none with an empty part."""
    keys = [sentence_key(x) for x in re.split(SENTENCE_END, text or "")]
    rests, rest = [""] * len(keys), b""
    for k in range(len(keys) - 1, 0, -1):
        if keys[k]:
            rest = hashlib.md5(keys[k].encode("utf-8", "surrogatepass") + b"\n" + rest).digest()
        rests[k] = rest.hex()
    out, head = [], hashlib.md5()
    for k in range(1, len(keys)):
        if keys[k - 1]:
            head.update(keys[k - 1].encode("utf-8", "surrogatepass") + b"\n")
            if rests[k]:
                out.append((k, head.hexdigest(), rests[k]))
    return out


def with_leads(items: DataFrame) -> DataFrame:
    """``items`` with question_lead and text_lead: how many sentences at the start are a standing instruction, which opens at least SHARED different texts."""
    parted = F.udf(openings, "array<struct<k: int, head: string, rest: string>>")
    texts = items.select(F.explode(F.array("question", "text")).alias("t")).filter("t is not null").distinct()
    ways = cut(texts.select(F.md5("t").alias("key"), F.explode(parted("t")).alias("x")).select("key", "x.*"), "openings")
    shared = ways.groupBy("head").agg(F.countDistinct("rest").alias("n")).filter(F.col("n") >= SHARED).select("head")
    leads = cut(ways.join(shared, "head", "left_semi").groupBy("key").agg(F.max("k").alias("lead")), "leads")
    for name in ("question", "text"):
        items = items.withColumn("key", F.md5(name)).join(leads.withColumnRenamed("lead", f"{name}_lead"), "key", "left").drop("key").fillna(0, [f"{name}_lead"])
    return items


def sentence_key(sentence: str) -> str:
    return " ".join(WORD.findall(fold(sentence)))


def verified(doc: np.ndarray, item: np.ndarray, shift: int, run: int, near: int) -> tuple[int, int] | None:
    """First and last word in the document of what it holds of the item on this diagonal, or None."""
    a, b = max(0, shift), min(len(doc), len(item) + shift)
    same = doc[a:b] == item[a - shift : b - shift]
    hold = []
    edges = np.flatnonzero(np.diff(np.r_[0, same.astype(np.int8), 0]))
    long = np.flatnonzero(edges[1::2] - edges[::2] >= run)
    if len(long):
        hold += [int(edges[2 * long[0]]), int(edges[2 * long[-1] + 1]) - 1]
    if near and len(same) >= near:
        score = np.r_[0, np.cumsum(np.where(same, 1, 1 - ODD))]
        # for each end the first start from which the words in between are within the threshold: the first prefix that is no greater
        least = np.minimum.accumulate(score)
        first = np.searchsorted(-least, -score, side="left")
        good = np.flatnonzero(np.arange(len(score)) - first >= near)
        if len(good):
            hold += [int(first[good].min()), int(good[-1]) - 1]
    return (a + min(hold), a + max(hold)) if hold else None


class Shard:
    """The documents of one shard as numbers of known tokens, and their index."""

    def __init__(self, texts: list[str], ids: dict[str, int], token: re.Pattern) -> None:
        self.texts, self.token, self.spans = texts, token, {}
        self.coded, symbols, place, owner = [], [], [], []
        for k, text in enumerate(texts):
            coded = np.fromiter((ids.get(t, 0) for t in token.findall(text)), np.int64)
            known = np.flatnonzero(coded)
            self.coded.append(coded)
            gap = np.r_[np.diff(known) > 1, True] if len(known) else np.zeros(0, bool)
            # each known word, and one separator after those that are followed by a gap
            at = np.repeat(known, 1 + gap)
            value = coded[at]
            value[np.cumsum(1 + gap)[gap] - 1] = 0
            symbols.append(value)
            place.append(at)
            owner.append(np.full(len(at), k))
        self.place, self.owner = np.concatenate(place), np.concatenate(owner)
        s = np.concatenate(symbols)
        self.index = FmIndex(s, len(ids) + 1) if len(s) else None

    def span(self, k: int, first: int, last: int) -> tuple[int, int]:
        """Characters of words ``first`` to ``last`` of text k."""
        if k not in self.spans:
            self.spans[k] = [m.span() for m in self.token.finditer(self.texts[k])]
        return self.spans[k][first][0], self.spans[k][last][1]


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of them, for each pair."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows in one array with REACH zeros around each, and where each begins."""
    gap = np.zeros(REACH + 1, np.int64)
    begins = np.cumsum([len(gap)] + [len(r) + len(gap) for r in rows[:-1]])
    return np.concatenate([x for r in rows for x in (gap, r)] + [gap]), begins


def paired(shard: Shard, p: Phrases, gram: np.ndarray, pos: np.ndarray, common: np.ndarray, run: int) -> np.ndarray:
    """Diagonals (text, part, shift) of common phrases that agree in two more words, outside of the stretch of common phrases, within REACH.

    A passage within the thresholds that has only common phrases left has such a pair: at most ``run`` - 1 of its words lie in the stretch of
    any of them, and of the others more match than there are runs of them. A longer stretch is a case of its own if it is there as a whole.
    """
    where = ranges(p.first[:-1][common], (p.first[1:] - p.first[:-1])[common])
    of = np.repeat(np.flatnonzero(common), (p.first[1:] - p.first[:-1])[common])
    by = np.lexsort((p.offset[where], p.part[where]))
    where, of = where[by], of[by]
    part, offset = p.part[where], p.offset[where]
    # stretches of places that follow each other
    new = np.r_[True, (part[1:] != part[:-1]) | (offset[1:] != offset[:-1] + 1)]
    at, ends = np.cumsum(new) - 1, np.r_[np.flatnonzero(new)[1:], len(new)] - 1
    size = p.grams.shape[1]
    low, high = offset[np.flatnonzero(new)][at], offset[ends][at] + size - 1
    whole = high - low + 1 >= run
    low, high = np.where(whole, offset, low), np.where(whole, offset + size - 1, high)
    here = common[gram]
    gram, pos = gram[here], pos[here]
    items, item_at = padded(p.parts)
    docs, doc_at = padded(shard.coded)
    i0, d0 = item_at[part] + offset, doc_at[shard.owner[pos]] + shard.place[pos]
    shift = shard.place[pos]
    base, out = max(int(items.max()), int(docs.max())) + 1, []
    for delta in range(-REACH, REACH + 1):
        y = offset + delta
        one, two = items[i0 + delta], items[i0 + delta + 1]
        fits = (one > 0) & (two > 0) & ((y + 1 < low) | (y > high))
        left, right = docs[d0 + delta], docs[d0 + delta + 1]
        seen = (left > 0) & (right > 0)
        if not fits.any() or not seen.any():
            continue
        pairs, codes = np.unique(np.r_[one[fits] * base + two[fits], left[seen] * base + right[seen]], return_inverse=True)
        a, b = of[fits] * len(pairs) + codes[: fits.sum()], gram[seen] * len(pairs) + codes[fits.sum() :]
        order = np.argsort(a, kind="stable")
        start, stop = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
        hit = np.flatnonzero(fits)[order][ranges(start, stop - start)]
        doc = np.repeat(np.flatnonzero(seen), stop - start)
        out.append(np.unique(np.stack([shard.owner[pos[doc]], part[hit], shift[doc] - offset[hit]], 1), axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def diagonals(shard: Shard, p: Phrases, run: int, near: int, least: int) -> np.ndarray:
    """text, part, shift of all diagonals that may hold a passage. ``least`` phrases of a passage match."""
    low, high = shard.index.search(p.grams)
    n, m = high - low, p.first[1:] - p.first[:-1]
    gram = np.repeat(np.arange(len(n)), n)
    pos = shard.index.locate(ranges(low, n))
    common = (np.minimum(n, m) > COMMON) & bool(near)
    # every occurrence of a phrase that is not common with every place of it
    rare = ~common[gram]
    g = gram[rare]
    where, at = ranges(p.first[g], m[g]), np.repeat(pos[rare], m[g])
    hits = np.stack([shard.owner[at], p.part[where], shard.place[at] - p.offset[where]], 1)
    found, count = np.unique(hits, axis=0, return_counts=True)
    if not common.any():
        return found[count >= least]
    # where common phrases may be part of a passage, fewer of the others are needed
    of = np.repeat(common, m)
    need = np.full(len(p.parts), least)
    for k in np.unique(p.part[of]):
        flags = np.zeros(len(p.parts[k]) + REACH, np.int64)
        flags[p.offset[of & (p.part == k)]] = 1
        total = np.r_[0, np.cumsum(flags)]
        need[k] = max(1, least - int((total[REACH:] - total[:-REACH]).max()))
    found = found[count >= need[found[:, 1]]]
    return np.unique(np.concatenate([found, paired(shard, p, gram, pos, common, run)]), axis=0)


def alike(shard: Shard, p: Phrases, found: np.ndarray, least: int, chunk: int = 4_000_000) -> np.ndarray:
    """The diagonals (text, part, shift) on which at least ``least`` words are equal, compared for many diagonals at once."""
    items, item_at = padded(p.parts)
    docs, doc_at = padded(shard.coded)
    text, part, shift = found[:, 0], found[:, 1], found[:, 2]
    first = np.maximum(0, shift)
    n = np.minimum(np.array([len(c) for c in shard.coded])[text], np.array([len(c) for c in p.parts])[part] + shift) - first
    kept, ends = [], np.cumsum(n)
    for a, b in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.unique(np.r_[0, np.searchsorted(ends, np.arange(chunk, ends[-1] if len(ends) else 0, chunk)), len(n)]))):
        here = slice(a, b)
        same = docs[ranges((doc_at[text] + first)[here], n[here])] == items[ranges((item_at[part] + first - shift)[here], n[here])]
        total = np.r_[0, np.cumsum(same)]
        stop = np.cumsum(n[here])
        kept.append(total[stop] - total[stop - n[here]] >= least)
    return found[np.concatenate(kept)] if kept else found


def search_shard(shard: Shard, p: Phrases, run: int, near: int, least: int) -> list[tuple[int, int, int, int]]:
    """text, item, start_char, end_char of every verified diagonal in one shard."""
    if shard.index is None:
        return []
    found = []
    for k, part, shift in alike(shard, p, diagonals(shard, p, run, near, least), run).tolist():
        if held := verified(shard.coded[k], p.parts[part], shift, run, near):
            found.append((k, int(p.items[part]), *shard.span(k, *held)))
    return found


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch["doc_id"], batch["text"]):
            ids.append(i)
            texts.append(fold(text))
            size += len(text)
            if size >= SHARD_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaked_passages(documents: DataFrame, items: DataFrame, item_chars: int = ITEM_CHARS) -> DataFrame:
    """doc_id, item_id, start_char, end_char of every passage of a test item in a document."""
    items = items.select("item_id", "question", "lang", "text").filter("item_id is not null").distinct()
    items = cut(with_leads(items), "items")
    size = items.agg(F.sum(F.length(F.concat_ws(" ", "question", "text")))).first()[0] or 0
    n = max(1, -(-size // item_chars))
    share = documents.sparkSession.sparkContext.broadcast
    word_ids, char_ids, blocks = {}, {}, []
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id").collect()
        words, chars = item_parts(rows)
        blocks.append(share((phrases(words, PHRASE, word_ids), phrases(chars, ZH_RUN, char_ids))))
    ids = share((word_ids, char_ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, chars = ids.value
        for doc_ids, texts in _shards(batches):
            han = [k for k, text in enumerate(texts) if HAN.search(text)] if chars else []
            in_words = Shard(texts, words, WORD) if words else None
            in_chars = Shard([texts[k] for k in han], chars, CHAR) if han else None
            for block in blocks:
                of_words, of_chars = block.value
                found = [(doc_ids[k], *rest) for k, *rest in search_shard(in_words, of_words, RUN, NEAR, 5)] if of_words else []
                if of_chars and in_chars:
                    found += [(doc_ids[han[k]], *rest) for k, *rest in search_shard(in_chars, of_chars, ZH_RUN, 0, 1)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start_char", "end_char"])

    texts = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return spread(texts).mapInPandas(run, "doc_id long, item_id long, start_char int, end_char int")


def leaking_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: every document that leaks an item."""
    return leaked_passages(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(passages: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char: overlapping passages merged to the spans to cut out of each document."""
    spans = passages.select("doc_id", "start_char", "end_char").distinct()
    before = "max(end_char) over (partition by doc_id order by start_char, end_char rows between unbounded preceding and 1 preceding)"
    opened = spans.withColumn("opens", F.expr(f"cast(coalesce(start_char > {before}, true) as int)"))
    run = opened.withColumn("run", F.expr("sum(opens) over (partition by doc_id order by start_char, end_char rows unbounded preceding)"))
    return run.groupBy("doc_id", "run").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("run")
