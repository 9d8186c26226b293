"""Katz backoff language model over the corpus, and the score of every text.

Levels. An n-gram of level m is a context of m - 1 words and the word after it;
a text is preceded by one begin mark, which is context only, and followed by one
end token, which is scored. With c the training count of an n-gram, C the sum of
c over its context's followers and d the Good-Turing discount of c,

    P(w | h) = d(c) c / C              where c > 0
             = alpha(h) P(w | h')      else, h' being h without its first word,

alpha(h) = (1 - sum of P over the seen) / (1 - sum of P(w | h') over the seen), so
each context's probabilities, one unknown word included, sum to one exactly. At
level 1 what the discounts leave is the unknown word's. A context not seen in
training has alpha 1. Discounts are Good-Turing's for counts of up to five,
d(r) = (r*/r - x) / (1 - x), r* = (r + 1) n(r + 1) / n(r), x = 6 n(6) / n(1);
where some d would not lie between 0 and 1, fewer counts are discounted. If no
follower of a context is discounted, C is taken one larger, which leaves the
unseen a share.

How it runs. Texts are read and split once, into chunks: records of a sorted
vocabulary (64-bit word hashes) and the words' places in it. Each level is an
exchange: a chunk sends each distinct n-gram once, with its training count and
its lower-level probability, to the part of its context; the part sums the
counts and keeps its n-grams (the model's partitioned tables); once the counts
of counts of all parts give the discounts, it replies with counts and alphas in
the order asked. An n-gram that one chunk only has asked for is that chunk's own: all
n-grams that go on from it are there too, so the chunk counts them itself and
sends no more than how many there are of each small count. Word ids ascend with falling counts, so that ids of contexts
and words pack into few bytes and a word's count follows from its id. A context with a large share of all words is spread over parts
by its followers, and its sums are added across parts. Then each chunk evaluates
its tokens level by level. No task holds more than a chunk or a part, whose
number grows with the input; the driver holds the counts that occur (at most the
root of twice the tokens) and the sums of at most ``8 * parts`` spread contexts.

Edge cases: null text counts as empty, and an empty text is its end token. Null
ids stay null (2^63 - 1, which stands for none, can't be an id); their remainder is that of the empty string. Repeated rows are
texts of their own, in training and results. Without training rows every token
is the unknown word, of probability one. A text longer than a chunk is a chunk
of its own. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack, pack_floats, pack_sorted, parts_of, ranges_of, raw, unpack, unpack_floats, unpack_sorted
from .common import Scratch

CHUNK_TOKENS, KEYS_PER_PART, DISCOUNTED, SEED, NO_ID = 1_500_000, 3_000_000, 5, 5, (1 << 63) - 1
#: Contexts from here on are a chunk's own, numbered by it.
OWN = 1 << 60
CHUNK = "chunk long, ids binary, held binary, row_tokens binary, vocabulary binary, train binary, numbers binary, tokens binary, words long, n_tokens long"
#: What a part sends back to a chunk: for level 1 the words' ids; above, counts, ids, and for each context C and, if one of the n-grams asked for is not seen, alpha.
REPLY = "chunk long, level long, part long, counts binary, ids binary, alphas binary, totals binary"


def discounts(n: list[int], most: int = DISCOUNTED) -> list[float]:
    """d(1), d(2), ... for as many counts as Good-Turing's ratios lie between 0 and 1. n[r]: how many n-grams occur r times."""
    for k in range(min(most, len(n) - 2), 0, -1):
        if not all(n[1 : k + 2]):
            continue
        x = (k + 1) * n[k + 1] / n[1]
        if x >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - x) / (1 - x) for r in range(1, k + 1)]
        if all(0 < v < 1 for v in d):
            return d
    return []


class Plan:
    """What all chunks and parts know: sizes of the exchanges, the discounts, the words' ids by count, and the spread contexts of each level."""

    def __init__(self, parts: int, own: bool = True):
        self.own = own  # whether chunks keep n-grams that only they have
        self.parts, self.discounts, self.spread, self.offsets, self.borders = {1: parts}, {}, {}, {}, {}

    def level_one(self, histogram: dict[int, tuple[int, int]]) -> None:
        """histogram: for each count the words that have it, in all and in the part with most of them. At most as many counts as the root of twice the tokens."""
        import numpy as np

        self.counts = np.array(sorted(histogram, reverse=True), np.int64)
        self.sizes = np.array([histogram[c][0] for c in self.counts.tolist()], np.int64)
        widths = np.array([histogram[c][1] for c in self.counts.tolist()], np.int64) * self.parts[1]
        self.starts = np.cumsum(widths) - widths
        self.begin = int(widths.sum())  # the begin mark's id follows the words'
        self.total, self.kinds = int((self.counts * self.sizes).sum()), int(self.sizes.sum())
        self.discounts[1] = discounts([0, *(histogram.get(r, (0, 0))[0] for r in range(1, DISCOUNTED + 2))])
        left = sum(r * (1 - d) * histogram[r][0] for r, d in enumerate(self.discounts[1], 1))
        self.floor = self.total + (not left)
        self.unknown = (left or 1) / self.floor

    def first_id(self, counts):
        import numpy as np

        if not len(self.counts):
            return np.zeros(len(counts), np.int64)
        return self.starts[np.minimum(np.searchsorted(-self.counts, -counts), len(self.counts) - 1)]

    def word_counts(self, ids):
        """Training counts of words; 0 for -1."""
        import numpy as np

        if not len(self.counts):
            return np.zeros(len(ids), np.int64)
        return np.where(ids < 0, 0, self.counts[np.searchsorted(self.starts, np.maximum(ids, 0), side="right") - 1])

    def word_p(self, ids):
        import numpy as np

        counts = self.word_counts(ids)
        return np.where(counts > 0, self.discount(1, counts) * counts / self.floor, self.unknown)

    def discount(self, level: int, counts):
        import numpy as np

        table = np.array([1.0, *self.discounts[level]])
        return np.where(counts < len(table), table[np.minimum(counts, len(table) - 1)], 1.0)

    def deal(self, level: int, parts: int, spread) -> None:
        """Parts of a level by context: for level 2 ranges of word ids with equal counts, so that neighbours pack well; above, by hash."""
        import numpy as np

        self.parts[level], self.spread[level] = parts, spread
        if level == 2 and len(self.counts):
            least = self.spread_above(parts)
            weight = np.where(self.counts > least, 0, self.counts * self.sizes)
            ends = np.cumsum(weight)
            aims = ends[-1] * np.arange(1, parts) / parts
            block = np.minimum(np.searchsorted(ends, aims), len(ends) - 1)
            share = (aims - (ends - weight)[block]) / np.maximum(weight[block], 1)
            widths = np.diff(np.append(self.starts, self.begin))
            self.borders[2] = self.starts[block] + (share * widths[block]).astype(np.int64)

    def spread_above(self, parts: int) -> int:
        """Contexts with more than an eighth of a part's share of all tokens are spread; they are 8 * parts at most."""
        return max(self.total // (8 * parts), 1000)

    def part_of(self, level: int, context, word):
        import numpy as np

        by_pair = (_mixed(_mixed(context) ^ _mixed(word + 2)) >> np.uint64(33)) % np.uint64(self.parts[level])
        if level in self.borders:
            by_context = np.searchsorted(self.borders[level], context, side="right")
        else:
            by_context = (_mixed(context) >> np.uint64(33)) % np.uint64(self.parts[level])
        return np.where(np.isin(context, self.spread[level]), by_pair.astype(np.int64), by_context.astype(np.int64))


def _mixed(x):
    import numpy as np

    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _encode(batches: Iterator, chunk_tokens: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    chunk = TaskContext.get().partitionId() << 32
    vocabulary: dict[bytes, int] = {b"": 0}  # the empty word is the end token
    ids, held, tokens, n = [], [], [], 0

    def record() -> pa.RecordBatch:
        nonlocal chunk, vocabulary, ids, held, tokens, n
        flat, sizes = np.concatenate(tokens), np.array([len(t) for t in tokens])
        training = np.repeat(~np.array(held), sizes)
        seen, train = np.bincount(flat, minlength=len(vocabulary)), np.bincount(flat[training], minlength=len(vocabulary))
        hashes = np.array([xxh64_intdigest(w, SEED) for w in vocabulary], np.uint64)
        by_hash = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int64)  # frequent words get small numbers, which pack well
        rank[np.argsort(-seen, kind="stable")] = np.arange(len(hashes))
        values = [chunk, raw(ids), raw(held, "u1"), pack(sizes), raw(hashes[by_hash], "<u8"), pack(train[by_hash]), pack(rank[by_hash]), pack(rank[flat]), len(hashes), len(flat)]
        chunk, vocabulary, ids, held, tokens, n = chunk + 1, {b"": 0}, [], [], [], 0
        kinds = (pa.int64(), *[pa.binary()] * 7, pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["chunk", "ids", "held", "row_tokens", "vocabulary", "train", "numbers", "tokens", "words", "n_tokens"])

    for rows in batches:
        for key, is_held, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split()
            words.append(b"")
            ids.append(NO_ID if key is None else key)
            held.append(is_held)
            tokens.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]))
            n += len(words)
            if n >= chunk_tokens:
                yield record()
    if ids:
        yield record()


def _table(rows: list[tuple], names: list[str], kinds: list):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _send_words(batches: Iterator, parts: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = []
        for chunk in batch.to_pylist():
            hashes = np.frombuffer(chunk["vocabulary"], "<u8")
            train = unpack(chunk["train"])
            rows += [(part, chunk["chunk"], raw(hashes[a:b], "<u8"), pack(train[a:b])) for part, a, b in ranges_of(hashes, parts)]
        yield from _table(rows, ["part", "chunk", "keys", "train"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]).to_batches()


#: A part of a level: its n-grams, the answers it owes, how many n-grams it has and how many of each count (at level 1 all counts, above the small ones).
PART = "part long, model binary, replies array<struct<chunk:long,places:binary>>, kinds long, histogram array<struct<count:long,n:long>>"


def _part_row(part: int, model: bytes, replies: list[dict], counts, most: int | None, more: list | None = None):
    """more: counts of counts of the n-grams that chunks keep."""
    import numpy as np
    import pyarrow as pa

    value, n = np.unique(counts[counts > 0] if most is None else counts[(counts > 0) & (counts <= most)], return_counts=True)
    histogram = [{"count": v, "n": k} for v, k in zip(value.tolist(), n.tolist(), strict=True)] + [{"count": v, "n": int(k)} for of in more or [] for v, k in enumerate(of) if k]
    reply = pa.list_(pa.struct([("chunk", pa.int64()), ("places", pa.binary())]))
    kinds = [pa.int64(), pa.binary(), reply, pa.int64(), pa.list_(pa.struct([("count", pa.int64()), ("n", pa.int64())]))]
    return _table([(part, model, replies, len(counts), histogram)], ["part", "model", "replies", "kinds", "histogram"], kinds)


def _sum_words(table):
    import numpy as np

    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
    some, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(place, np.concatenate([unpack(r["train"]) for r in rows]), len(some)).astype(np.int64)
    replies, at = [], 0
    for r, own in zip(rows, keys, strict=True):
        mine = place[at : at + len(own)]
        replies.append({"chunk": r["chunk"], "places": pack_sorted(mine)})
        at += len(own)
    return _part_row(rows[0]["part"], raw(some, "<u8") + pack(counts), replies, counts, None)


def _word_ids(part: dict, plan: Plan):
    """Ids of a part's words, -1 for those without a training count. Frequent words have small ids, and a word's count follows from its id."""
    import numpy as np

    counts = unpack(part["model"][8 * part["kinds"] :])
    order = np.argsort(-counts, kind="stable")
    ordered = counts[order]
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    ids = np.empty(len(order), np.int64)
    ids[order] = plan.first_id(ordered) + rank * plan.parts[1] + part["part"]
    return np.where(counts > 0, ids, -1), counts


def _asked(part: dict, kinds: int, plan: Plan):
    """The places that each reply answers, and for each n-gram whether it is one chunk's own."""
    import numpy as np

    places = [unpack_sorted(r["places"]) for r in part["replies"]]
    return places, (np.bincount(np.concatenate(places), minlength=kinds) == 1) & plan.own


def _reply_words(batches: Iterator, plan: Plan) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = []
        for part in batch.to_pylist():
            ids, _ = _word_ids(part, plan)
            places, single = _asked(part, len(ids), plan)
            for r, mine in zip(part["replies"], places, strict=True):
                rows.append((r["chunk"], 1, part["part"], None, pack(2 * (ids[mine] + 1) + single[mine]), None, None))
        yield from _table(rows, [x.split()[0] for x in REPLY.split(", ")], [pa.int64()] * 3 + [pa.binary()] * 4).to_batches()


def _pairs(context, word):
    """Of the distinct pairs, in ascending order: a place in the input of each, and the place of each input pair among them."""
    import numpy as np

    if len(context) and context.max() < 1 << 31 and word.max() < (1 << 31) - 1 and word.min() >= -1:
        key = (context << 32) | (word + 1)
        order = np.argsort(key)  # not stable, which is many times faster: any token of a pair may stand for it
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return order[new], place
    order = np.lexsort((word, context))
    new = np.concatenate(([True], (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1]))) if len(order) else np.empty(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _begins(context):
    """Where a context differs from the one before."""
    import numpy as np

    return np.concatenate(([True], context[1:] != context[:-1]))[: len(context)]


def _backed_off(new, counts):
    """Of groups that begin where new holds, those that hold a count of 0. Only they need an alpha: few, as all n-grams of training texts are seen."""
    import numpy as np

    return np.flatnonzero(np.add.reduceat(counts == 0, np.flatnonzero(new)) > 0) if len(counts) else np.empty(0, np.int64)


class State:
    """A chunk's tokens, evaluated up to a level: word ids (-1: unknown), training counts, probabilities, and each token's context for the next level (-1: not seen; from OWN on: the chunk's own). From level 2 on, also the counts n of the tokens' n-grams and their contexts' C (total)."""

    def __init__(self, chunk: dict, replies: list[dict], plan: Plan):
        import numpy as np

        self.plan, self.ids = plan, np.frombuffer(chunk["ids"], "<i8")
        self.held, self.sizes = np.frombuffer(chunk["held"], "u1").astype(bool), unpack(chunk["row_tokens"])
        tokens = unpack(chunk["tokens"])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~self.held, self.sizes)
        answers = np.empty(chunk["words"], np.int64)  # the parts' answers, in order, are those to the words by hash
        answers[unpack(chunk["numbers"])] = np.concatenate([unpack(r["ids"]) for r in sorted((r for r in replies if r["level"] == 1), key=lambda r: r["part"])])
        ids = (answers >> 1) - 1
        self.word, self.count, self.p = ids[tokens], plan.word_counts(ids)[tokens], plan.word_p(ids)[tokens]
        self.context = self._after(np.where((answers % 2 == 1) & (ids >= 0), OWN + np.arange(len(ids)), ids)[tokens], plan.begin)
        for level in range(2, max(plan.discounts) + 1):  # a chunk may have n-grams of its own alone, and no replies
            self._climb(level, [r for r in replies if r["level"] == level])

    def _after(self, ids, at_first: int):
        """Each token's predecessor's id; at_first for a text's first token."""
        import numpy as np

        out = np.empty(len(ids), np.int64)
        out[1:] = ids[:-1]
        out[self.first] = at_first
        return out

    def ask(self, level: int):
        """What this chunk asks at a level: places of the first of each distinct pair, part borders, and each asking token's place among the pairs."""
        import numpy as np

        asking = np.flatnonzero((self.context >= 0) & (self.context < OWN))
        first, place = _pairs(self.context[asking], self.word[asking])
        first = asking[first]
        part = self.plan.part_of(level, self.context[first], self.word[first])
        order = np.argsort(part, kind="stable")  # within a part still by context and word
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        return asking, first[order], where[place], np.searchsorted(part[order], np.arange(self.plan.parts[level] + 1))

    def own(self):
        """The chunk's own pairs: tokens with such a context, the first of each distinct pair, each token's place among the pairs, and the pairs' training counts."""
        import numpy as np

        tokens = np.flatnonzero(self.context >= OWN)
        first, place = _pairs(self.context[tokens] - OWN, self.word[tokens])
        first = tokens[first]
        train = np.bincount(place, self.training[tokens], len(first)).astype(np.int64)
        train[self.word[first] < 0] = 0
        return tokens, first, place, train

    def _climb(self, level: int, replies: list[dict]) -> None:
        import numpy as np

        tokens, first, own_place, train = self.own()
        seen, lower = train > 0, self.p[first]
        new = np.concatenate(([True], self.context[first][1:] != self.context[first][:-1]))[: len(first)]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        kept = self.plan.discount(level, train) * train
        total, alpha = _normalised(*(np.add.reduceat(x, at) if len(at) else np.empty(0) for x in (train, kept, np.where(seen, lower, 0.0))))
        own_p = np.where(seen, kept / np.maximum(total[group], 1), alpha[group] * lower)
        own_ids = np.where(seen, OWN + np.arange(len(first)), -1)
        n_own, own_counts, own_totals = len(first), train, total[group]

        asking, first, place, cuts = self.ask(level)
        p, ids, n, c = np.empty(len(first)), np.full(len(first), -1), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for r in replies:
            a, b = cuts[r["part"]], cuts[r["part"] + 1]
            own, counts = first[a:b], unpack(r["counts"])
            new = np.concatenate(([True], self.context[own][1:] != self.context[own][:-1]))
            group, alpha = np.cumsum(new) - 1, np.ones(new.sum())
            alpha[_backed_off(new, counts)] = unpack_floats(r["alphas"])
            total = unpack(r["totals"])[group]
            seen = counts > 0
            n[a:b], c[a:b] = counts, total
            p[a:b] = np.where(seen, self.plan.discount(level, counts) * counts / np.maximum(total, 1), alpha[group] * self.p[own])
            if r["ids"] is not None:  # 0: not seen, 1: the chunk's own
                answer = unpack(r["ids"])
                ids[a:b] = np.where(answer == 1, OWN + n_own + np.arange(a, b), np.maximum(answer - 2, -1))
        self.p[asking], self.p[tokens] = p[place], own_p[own_place]
        self.n, self.total = np.zeros(len(self.word), np.int64), np.zeros(len(self.word), np.int64)
        self.n[asking], self.n[tokens] = n[place], own_counts[own_place]
        self.total[asking], self.total[tokens] = c[place], own_totals[own_place]
        full = np.full(len(self.word), -1)
        full[asking], full[tokens] = ids[place], own_ids[own_place]
        # The begin mark alone has no id at higher levels: a text's first token backs off from a context that starts the text.
        self.context = self._after(full, -1)


def _send_pairs(chunk_rows, reply_rows, plan: Plan, level: int):
    import numpy as np
    import pyarrow as pa

    names, kinds = ["part", "chunk", "contexts", "words", "train", "lower_n", "lower_total"], [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    rows = []
    for chunk in chunk_rows.to_pylist():
        s = State(chunk, reply_rows.to_pylist(), plan)
        asking, first, place, cuts = s.ask(level)
        train = np.bincount(place, s.training[asking], len(first)).astype(np.int64)
        train[s.word[first] < 0] = 0
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[part], cuts[part + 1]
            f = first[a:b]
            rows.append((part, chunk["chunk"], pack_sorted(s.context[f]), pack(s.word[f] + 1), pack(train[a:b]), *((pack(np.where(train[a:b] > 0, s.n[f], 0)), pack(s.total[f][_begins(s.context[f])])) if level > 2 else (None, None))))
        *_, train = s.own()
        if len(train):  # how many of the chunk's own n-grams have each small count
            few = np.bincount(train[(train > 0) & (train <= DISCOUNTED + 1)], minlength=1)
            rows.append((chunk["chunk"] % plan.parts[level], chunk["chunk"], None, None, pack(few), None, None))
    return _table(rows, names, kinds)


def _sender(plan: Plan, level: int):
    return lambda chunk_rows, reply_rows: _send_pairs(chunk_rows, reply_rows, plan, level)


def _sum_pairs(table):
    """Counts of a part's pairs. Where a word's id doesn't tell its lower-level probability, the count (for the seen) and, once a context, the C that give it are carried: integers, which pack well."""
    import numpy as np

    every = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    rows, part = [r for r in every if r["contexts"] is not None], every[0]["part"]
    kept = [unpack(r["train"]) for r in every if r["contexts"] is None]
    contexts = [unpack_sorted(r["contexts"]) for r in rows]
    empty = [np.empty(0, np.int64)]
    context, word = np.concatenate(contexts or empty), np.concatenate([unpack(r["words"]) for r in rows] or empty) - 1
    first, place = _pairs(context, word)
    counts = np.bincount(place, np.concatenate([unpack(r["train"]) for r in rows] or empty), len(first)).astype(np.int64)
    lower_n, lower_total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    carried = bool(rows) and rows[0]["lower_n"] is not None
    if carried:
        np.maximum.at(lower_n, place, np.concatenate([unpack(r["lower_n"]) for r in rows]))
        lower_total[place] = np.concatenate([unpack(r["lower_total"])[np.cumsum(_begins(x)) - 1] for r, x in zip(rows, contexts, strict=True)])
    context, word = context[first], word[first]
    replies, at = [], 0
    for r, own in zip(rows, contexts, strict=True):
        mine = place[at : at + len(own)]
        replies.append({"chunk": r["chunk"], "places": pack_sorted(mine)})
        at += len(own)
    blobs = [pack_sorted(context), pack(word + 1), pack(counts), *((pack(lower_n), pack(lower_total[_begins(context)])) if carried else (b"", b""))]
    model = raw([len(b) for b in blobs]) + b"".join(blobs)
    return _part_row(part, model, replies, counts, DISCOUNTED + 1, kept)


def open_words(model: bytes, kinds: int):
    """Word hashes (XXH64, ascending) and training counts of a kept part of level 1."""
    import numpy as np

    return np.frombuffer(model[: 8 * kinds], "<u8"), unpack(model[8 * kinds :])


def open_pairs(model: bytes):
    """Context ids, word ids (-1: unknown) and training counts of a kept part of a higher level, in ascending order."""
    import numpy as np

    ends = np.cumsum([40, *np.frombuffer(model[:40], "<i8").tolist()]).tolist()
    return unpack_sorted(model[ends[0] : ends[1]]), unpack(model[ends[1] : ends[2]]) - 1, unpack(model[ends[2] : ends[3]])


def _open_model(model: bytes, plan: Plan, level: int):
    """context, word, count and lower-level probability (of the seen) of a part's pairs, in ascending order."""
    import numpy as np

    ends = np.cumsum([40, *np.frombuffer(model[:40], "<i8").tolist()]).tolist()
    n, total = (model[x:y] for x, y in zip(ends[3:-1], ends[4:], strict=True))
    context, word, counts = open_pairs(model)
    if not n:
        return context, word, counts, plan.word_p(word)
    n, total = unpack(n), unpack(total)[np.cumsum(_begins(context)) - 1]
    return context, word, counts, plan.discount(level - 1, n) * n / np.maximum(total, 1)


def _context_sums(plan: Plan, level: int, model: bytes):
    """Per context: id, C, discounted count, lower-level probability of the seen; and each pair's context place."""
    import numpy as np

    context, _, counts, lower = _open_model(model, plan, level)
    if not len(context):
        return context, [np.empty(0)] * 3, context
    new = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    seen = counts > 0
    kept = plan.discount(level, counts) * counts
    sums = [np.add.reduceat(x, new) for x in (counts, kept, np.where(seen, lower, 0.0))]
    return context[new], sums, np.repeat(np.arange(len(new)), np.diff(np.append(new, len(context))))


def _normalised(total, kept, lower):
    """C and alpha of contexts, from their count, discounted count and lower-level probability of the seen."""
    import numpy as np

    total = total + ((kept >= total) & (total > 0))  # nothing discounted: a share of one for the unseen
    return total, np.where(total > 0, (1 - kept / np.maximum(total, 1)) / np.maximum(1 - lower, 1e-300), 1.0)


def _spread_sums(batches: Iterator, plan: Plan, level: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for model in batch.column("model").to_pylist():
            context, sums, _ = _context_sums(plan, level, model)
            some = np.isin(context, plan.spread[level])
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (context, *sums)], names=["context", "total", "kept", "lower"])


def _reply_pairs(batches: Iterator, plan: Plan, level: int, spread: dict[int, tuple], more: bool) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = []
        for part in batch.to_pylist():
            context, (total, kept, lower), group = _context_sums(plan, level, part["model"])
            for k in np.flatnonzero(np.isin(context, plan.spread[level])):
                total[k], kept[k], lower[k] = spread[int(context[k])]
            total, alpha = _normalised(total, kept, lower)
            if not part["replies"]:
                continue
            counts = open_pairs(part["model"])[2]
            asked, single = _asked(part, len(counts), plan)
            names = np.where(counts > 0, np.where(single, 1, np.arange(len(counts)) + plan.offsets[level][part["part"]] + 2), 0)
            for r, places in zip(part["replies"], asked, strict=True):
                own = group[places]
                new = np.concatenate(([True], own[1:] != own[:-1]))
                own = own[new]
                rows.append((r["chunk"], level, part["part"], pack(counts[places]), pack(names[places]) if more else None, pack_floats(alpha[own[_backed_off(new, counts[places])]]), pack(total[own])))
        yield from _table(rows, [x.split()[0] for x in REPLY.split(", ")], [pa.int64()] * 3 + [pa.binary()] * 4).to_batches()


def _evaluate(chunk_rows, reply_rows, plan: Plan):
    import numpy as np
    import pyarrow as pa

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = []
    for chunk in chunk_rows.to_pylist():
        s = State(chunk, reply_rows.to_pylist(), plan)
        total = lambda x, s=s: np.add.reduceat(x, s.first)
        base = np.log10((s.count + 1) / (plan.total + plan.kinds + 1))
        ids = pa.array(s.ids, pa.int64(), mask=s.ids == NO_ID)
        found.append(pa.Table.from_arrays([ids, pa.array(s.held), pa.array(s.sizes), pa.array(total((s.count > 0).astype(np.int64))), pa.array(np.full(len(s.ids), plan.total)), pa.array(total(base)), pa.array(total(np.log10(s.p)))], names=names))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.concat_tables(found) if found else _table([], names, kinds)


def score_corpus(docs: DataFrame, held_out, order: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, model_path: str | None = None) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability).

    held_out: a boolean column; rows where it is false train the model.
    model_path: where to keep the n-gram tables (ngrams1, ngrams2, ... by part;
    open_words and open_pairs read a part's model), else they go with the run. If
    they are kept, chunks send their own n-grams too, so that the tables hold all.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    chunks = scratch.table(rows.mapInArrow(lambda b: _encode(b, chunk_tokens), CHUNK), "chunks")
    size = chunks.agg(F.sum("words").alias("words"), F.sum("n_tokens").alias("tokens")).first()

    plan = Plan(parts_of(size["words"] or 0, KEYS_PER_PART, least), own=not model_path)
    parts = plan.parts[1]
    sent = chunks.select("chunk", "vocabulary", "train").mapInArrow(lambda b: _send_words(b, parts), "part long, chunk long, keys binary, train binary")
    model = scratch.table(sent.repartition(parts, "part").groupBy("part").applyInArrow(_sum_words, PART), "ngrams1")
    counted = model.select(F.inline("histogram")).groupBy("count").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    plan.level_one({r["count"]: (r["n"], r["most"]) for r in counted.collect()})
    replies = scratch.table(model.select("part", "model", "kinds", "replies").mapInArrow(lambda b: _reply_words(b, plan), REPLY), "replies1")
    chunks = scratch.table(chunks.drop("vocabulary", "train"), "tokens")
    scratch.drop("chunks")

    for level in range(2, order + 1):
        parts = parts_of(size["tokens"] or 0, KEYS_PER_PART, least)
        plan.deal(level, parts, _spread(model, plan, level, parts))
        if not model_path:
            scratch.drop(f"ngrams{level - 1}")
        sent = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_sender(plan, level), "part long, chunk long, contexts binary, words binary, train binary, lower_n binary, lower_total binary")
        model = scratch.table(sent.repartition(parts, "part").groupBy("part").applyInArrow(_sum_pairs, PART), f"ngrams{level}")
        counted = model.select(F.inline("histogram")).groupBy("count").agg(F.sum("n").alias("n"))
        n = {r["count"]: r["n"] for r in counted.collect()}
        plan.discounts[level] = discounts([0, *(n.get(r, 0) for r in range(1, DISCOUNTED + 2))])
        at, plan.offsets[level] = 0, {}
        for r in model.select("part", "kinds").orderBy("part").collect():  # one small row for each part
            plan.offsets[level][r["part"]] = at
            at += r["kinds"]
        spread = _spread_totals(model, plan, level)
        answered = model.select("part", "model", "replies").mapInArrow(_replier(plan, level, spread, level < order), REPLY)
        replies = replies.unionByName(scratch.table(answered, f"replies{level}"))
    if not model_path:
        scratch.drop(f"ngrams{order}")

    for level in range(1, order + 1) if model_path else ():
        kept = spark.read.parquet(f"{scratch.path}/ngrams{level}").select("part", "kinds", "model")
        kept.write.mode("overwrite").partitionBy("part").parquet(f"{model_path}/ngrams{level}")

    scored = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda a, b: _evaluate(a, b, plan), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)


def _replier(plan: Plan, level: int, spread: dict[int, tuple], more: bool):
    return lambda batches: _reply_pairs(batches, plan, level, spread, more)


def _spread_totals(model: DataFrame, plan: Plan, level: int) -> dict[int, tuple]:
    """Sums of the spread contexts over all parts."""
    sums = model.select("model").mapInArrow(lambda b: _spread_sums(b, plan, level), "context long, total long, kept double, lower double")
    sums = sums.groupBy("context").agg(F.sum("total").alias("total"), F.sum("kept").alias("kept"), F.sum("lower").alias("lower"))
    return {r["context"]: (r["total"], r["kept"], r["lower"]) for r in sums.collect()}


def _spread(model: DataFrame, plan: Plan, level: int, parts: int):
    """Ids of the n-grams, contexts of this level, that are to be spread."""
    import numpy as np

    least = plan.spread_above(parts)

    def large(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in batch.to_pylist():
                if level == 2:
                    ids, counts = _word_ids(part, plan)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[counts > least])], names=["id"])
                else:
                    counts = open_pairs(part["model"])[2]
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts > least) + plan.offsets[level - 1][part["part"]])], names=["id"])

    found = [r["id"] for r in model.select("part", "model", "kinds").mapInArrow(large, "id long").collect()]
    begin = [plan.begin] if level == 2 else []  # the begin mark's count is that of the training rows
    return np.array(sorted(found) + begin, np.int64)
