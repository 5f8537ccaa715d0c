"""Personal data: high-recall proposals, boosted trees over format and context, calibrated selection.

Two generators look for spans: maximal runs of digits and the signs that go with numbers, and words that
hold an ``@``. Inside them lie the spans of four fixed formats (e-mail, IP address, card, phone), which are
always personal data. In a run, every sequence of up to ``GROUPS`` digit groups that touches no fixed span is
proposed, and a whole run without one however long it is (fixed formats have at most 19
groups); so is every word without an e-mail. Boosted trees learn from format and context
what tells fixed spans from proposals. A proposal becomes a span of its own (kind ``number`` or ``address``)
if its probability reaches half of the mean probability of the positives of its generator (the usual
correction when only some positives carry a label). Whether a number has a ``+`` is part of a fixed format
and no feature. Of proposals that overlap, the one with the higher score stays, then the one whose number of
digits is nearer to a positive's, the longer and the first. Where spans are cut from a run, a proposal left
over that has a fixed format by itself is one too.

Everything is a column expression over one row, trees included: no shuffle, no join, no Python on the
executors. Regular expressions are written so that they run in linear time on any text. Positions are
running sums in two levels, groups inside fixed spans are told by a running maximum, and a proposal looks for overlaps at its own
stretch of a map of the run, so many spans in one text stay cheap. The trees are fitted by Spark ML on
all spans and proposals of all distinct texts, counted by features: features are small numbers, so there are
far fewer of their combinations than proposals. Thresholds and digit counts come from the same table.

Nulls and ties: a null text is an empty one and has no spans. Without positives in the documents nothing
beyond the fixed formats is selected. Spans of a kind never overlap; spans of different kinds may.
Repeated rows get the same result each. Empty tables give no rows. Columns named like the added ones
are replaced, others are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.text import SPACE, cut_lineage, table

SIZES = 1000  # digit counts of positives kept, the most frequent; they only break ties
TREES, DEPTH = 10, 3
BINS, SPLIT_ROWS = 32, 10_000  # Spark ML looks for splits in a sample of max(bins ** 2, this many) rows
BLOCK = 64
CHUNK = 4096  # code points of a text that a piece is taken from

# Proposals. Any fixed span lies wholly inside one of them.
NUMBERS = r"\+?[0-9](?:[+0-9\x20().-]*[0-9])?"
SHORTEST = 7
GROUPS = 20  # digit groups of a proposal inside a run
ADDRESSES = rf"(?<![^{SPACE}])[^{SPACE}@]*+@[^{SPACE}]*+"
# The fixed formats, as the contract of the query has them, without backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

KINDS = ["email", "ip", "card", "phone"]
FEATURES = ["address", "digits", "length", "groups", "longest", "signs", "dots", "before", "after", "named"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda a repeated expression would run again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def before_each(lengths: Column) -> Column:
    """Sum of the elements before each element, over blocks and inside a block."""

    def placed(held: Column) -> Column:
        block = lambda i: (i / BLOCK).cast("int")
        inside = lambda i: total(F.slice(held.l, block(i) * BLOCK + 1, i % BLOCK))
        return F.transform(held.l, lambda _, i: F.element_at(held.b, block(i) + 1) + inside(i))

    sums = F.transform(
        F.sequence(F.lit(0), (F.size(lengths) / BLOCK).cast("int")), lambda j: total(F.slice(lengths, j * BLOCK + 1, F.lit(BLOCK)))
    )
    blocks = let(sums, lambda s: F.transform(s, lambda _, j: total(F.slice(s, F.lit(1), j))))
    return let(F.struct(lengths.alias("l"), blocks.alias("b")), placed)


def matches(text: Column, pattern: str) -> Column:
    """Array of (m, start, before, after) of the matches: code points from 0, and the characters around."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def positions(c: Column) -> Column:
        lengths = F.zip_with(F.slice(c.p, 1, F.size(c.m)), c.m, lambda p, m: F.length(p) + F.length(m))
        return F.transform(
            F.arrays_zip(c.m.alias("m"), before_each_of(lengths).alias("s")),
            lambda x, i: F.struct(
                x.m.alias("m"),
                (x.s + F.length(F.element_at(c.p, i + 1))).alias("start"),
                F.right(F.element_at(c.p, i + 1), F.lit(24)).alias("before"),
                F.left(F.element_at(c.p, i + 2), F.lit(1)).alias("after"),
            ),
        )

    return let(cut, positions)


def before_each_of(lengths: Column) -> Column:
    return let(lengths, before_each)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Digits from the right, every second doubled with its own digits added up; a multiple of 10 in all."""
    turned = F.split(F.reverse(number), "")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.slice(turned, 1, F.length(number)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return total(each) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(digits(m))
    return F.length(digits(m)).between(8, 15)


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def fixed_inside(kind: str, proposal: Column) -> Column:
    """Spans (start, end) of a fixed format inside a proposal, as places in the text."""
    found = F.filter(matches(proposal.m, PATTERNS[kind]), lambda x: valid(kind, x.m))
    return F.transform(found, lambda x: F.struct((proposal.start + x.start).alias("start"), (proposal.start + x.start + F.length(x.m)).alias("end")))


PROPOSAL = "array<struct<m:string,start:int,before:string,after:string>>"
SPANS = "array<struct<start:int,end:int>>"


def proposal(m: Column, start: Column, before: Column, after: Column) -> Column:
    return F.struct(m.alias("m"), start.alias("start"), before.alias("before"), after.alias("after"))


def inside_spans(places: Column, spans: Column) -> Column:
    """Whether each of the places, which rise, lies in one of the spans: the largest end of those that start up to it is past it."""
    opened = F.transform(spans, lambda f: F.struct(f.start.alias("at"), F.lit(0).alias("place"), f.end.alias("end")))
    asked = F.transform(places, lambda p: F.struct(p.alias("at"), F.lit(1).alias("place"), F.lit(-1).alias("end")))

    def told(events: Column) -> Column:
        reach = let(F.transform(events, lambda e: e.end), highest_before)
        each = F.zip_with(events, reach, lambda e, r: F.struct(e.place.alias("place"), (r > e.at).alias("taken")))
        return F.transform(F.filter(each, lambda e: e.place == 1), lambda e: e.taken)

    return let(F.array_sort(F.concat(opened, asked)), told)


def free_sequences(run: Column, fixed: Column) -> Column:
    """Proposals inside a run: sequences of digit groups, with a + right before, that touch none of the ``fixed`` spans."""
    cut = F.struct(F.regexp_extract_all(run.m, F.lit("[0-9]+"), F.lit(0)).alias("d"), F.split(run.m, "[0-9]+", -1).alias("s"))

    def groups(c: Column) -> Column:
        lengths = F.zip_with(F.slice(c.s, 1, F.size(c.d)), c.d, lambda s, d: F.length(s) + F.length(d))

        def group(x: Column, i: Column) -> Column:
            sign = F.element_at(c.s, i + 1)
            start = run.start + x.b + F.length(sign)
            return F.struct(x.m.alias("m"), sign.alias("sign"), start.alias("start"), F.element_at(c.s, i + 2).alias("next"))

        return F.transform(F.arrays_zip(c.d.alias("m"), before_each_of(lengths).alias("b")), group)

    def marked(g: Column) -> Column:
        taken = F.when(F.size(fixed) == 0, F.transform(g, lambda x: F.lit(False))).otherwise(inside_spans(F.transform(g, lambda x: x.start), fixed))
        return F.zip_with(g, taken, lambda x, t: F.struct(x.m.alias("m"), x.sign.alias("sign"), x.start.alias("start"), x.next.alias("next"), t.alias("taken")))

    def from_each(g: Column) -> Column:
        def from_one(x: Column, i: Column) -> Column:
            plus = x.sign.endswith("+")
            earlier = F.concat(F.get(g, i - 1).m, F.when(plus, F.substr(x.sign, F.lit(1), F.length(x.sign) - 1)).otherwise(x.sign))

            def sequence(k: Column) -> Column:
                rest = F.transform(F.slice(g, i + 2, k - 1), lambda y: F.concat(y.sign, y.m))
                return proposal(
                    F.concat(F.when(plus, "+").otherwise(""), x.m, F.array_join(rest, "")),
                    x.start - plus.cast("int"),
                    F.when(i == 0, run.before).otherwise(F.right(earlier, F.lit(24))),
                    F.when(i + k == F.size(g), run.after).otherwise(F.left(F.element_at(g, i + k).next, F.lit(1))),
                )

            # Groups up to the first that is part of a fixed span.
            near = F.slice(g, i + 1, F.lit(GROUPS))
            stop = F.array_position(F.transform(near, lambda y: y.taken), True).cast("int")
            most = F.when(stop == 0, F.size(near)).otherwise(stop - 1)
            return let(most, lambda m: F.when(m == 0, F.array().cast(PROPOSAL)).otherwise(F.transform(F.sequence(F.lit(1), m), sequence)))

        inside = F.filter(F.flatten(F.transform(g, from_one)), lambda y: F.length(y.m) >= SHORTEST)
        whole = F.when((F.size(g) > GROUPS) & (F.size(fixed) == 0), F.array(proposal(run.m, run.start, run.before, run.after))).otherwise(F.array().cast(PROPOSAL))
        return F.concat(inside, whole)

    return let(let(let(cut, groups), marked), from_each)


def proposals(text: Column) -> Column:
    """numbers and addresses: runs and words with the fixed spans found inside each, and what is proposed besides (``free``)."""
    numbers = F.when(
        text.rlike(r"[0-9][+0-9\x20().-]{5,}"), F.filter(matches(text, NUMBERS), lambda x: F.length(x.m) >= SHORTEST)
    ).otherwise(F.array().cast(PROPOSAL))
    addresses = F.when(F.contains(text, F.lit("@")), matches(text, ADDRESSES)).otherwise(F.array().cast(PROPOSAL))

    def fixed(kinds: list[str], free: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            found = F.struct(*[fixed_inside(k, x).alias(k) for k in kinds])
            fields = [x.m.alias("m"), x.start.alias("start"), x.before.alias("before"), x.after.alias("after")]
            return let(found, lambda f: F.struct(*fields, *[f.getField(k).alias(k) for k in kinds], free(x, F.concat(*[f.getField(k) for k in kinds])).alias("free")))

        return one

    word = lambda x, found: F.when(F.size(found) == 0, F.array(proposal(x.m, x.start, x.before, x.after))).otherwise(F.array().cast(PROPOSAL))
    return F.struct(
        F.transform(numbers, fixed(KINDS[1:], free_sequences)).alias("numbers"), F.transform(addresses, fixed(KINDS[:1], word)).alias("addresses")
    )


def sort_of_character(c: Column) -> Column:
    return F.when(c.isNull() | (c == "") | (c == "\n"), 0).when(c == " ", 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike(r"\p{N}"), 3).otherwise(4)


def features(x: Column, address: bool) -> dict[str, Column]:
    """Format and context of a proposal, as small numbers; none of them is the check of a fixed format."""
    run = lambda pattern: F.regexp_count(x.m, F.lit(pattern))
    longest = F.array_max(F.transform(F.regexp_extract_all(x.m, F.lit("[0-9]+"), F.lit(0)), lambda d: F.length(d)))
    named = x.before.rlike(r"(?i)(?:tel|phone|call|fax|mail|card|account|contact|address|ip|id|no)[.:#\x20]*$")
    return {
        "address": F.lit(int(address)),
        "digits": run("[0-9]"),
        "length": F.length(x.m),
        "groups": run("[0-9]+"),
        "longest": F.coalesce(longest, F.lit(0)),
        "signs": run("[^0-9A-Za-z.+]"),
        "dots": run(r"\."),
        "before": sort_of_character(F.right(x.before, F.lit(1))),
        "after": sort_of_character(x.after),
        "named": named.cast("int"),
    }


def training_rows(documents: DataFrame, text: str = "text") -> DataFrame:
    """Features and label of all fixed spans (words that hold one, for addresses) and proposals, each combination once; ``weight`` is how often it occurs."""
    rows = documents.filter(F.col(text).rlike(r"[0-9][+0-9\x20().-]{5,}|@")).select(F.xxhash64(F.lit(7), text).alias("draw"), F.col(text).alias("text"))
    # Copies of a document count once.
    chosen = rows.dropDuplicates(["draw"])

    def row(x: Column, address: bool, label: int) -> Column:
        return F.struct(F.lit(label).alias("label"), *[v.cast("double").alias(n) for n, v in features(x, address).items()])

    def rows_of(x: Column, address: bool) -> Column:
        def inside(s: Column) -> Column:
            start, end = s.start - x.start, s.end - x.start
            before, after = F.concat(x.before, F.left(x.m, start)), F.concat(F.substr(x.m, end + 1), x.after)
            return proposal(F.substr(x.m, start + 1, end - start), s.start, F.right(before, F.lit(24)), F.left(after, F.lit(1)))

        if address:
            known = F.when(F.size(x.email) > 0, F.array(proposal(x.m, x.start, x.before, x.after))).otherwise(F.array().cast(PROPOSAL))
        else:
            known = F.transform(F.concat(*[x.getField(k) for k in KINDS[1:]]), inside)
        return F.concat(F.transform(known, lambda y: row(y, address, 1)), F.transform(x.free, lambda y: row(y, address, 0)))

    found = chosen.select(proposals(F.col("text")).alias("p"))
    each = F.concat(F.flatten(F.transform("p.numbers", lambda x: rows_of(x, False))), F.flatten(F.transform("p.addresses", lambda x: rows_of(x, True))))
    rows = found.select(F.explode(each).alias("r")).select("r.*")
    return rows.groupBy("label", *FEATURES).agg(F.count("*").cast("double").alias("weight"))


def as_column(node, names: list[str], of: Callable[[str], Column]) -> Column:
    """A fitted regression tree as a nested CASE."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    low, high = as_column(node.leftChild(), names, of), as_column(node.rightChild(), names, of)
    return F.when(of(names[node.split().featureIndex()]) <= float(node.split().threshold()), low).otherwise(high)


def best_first(spans: Column) -> Column:
    """Of spans (start, end), best first, those that meet none taken before them; (start, end), in order.

    What is taken is written into a map of the stretch with a byte for each code point, so that a span looks
    at its own stretch only, however many are taken.
    """
    written = lambda sign, n: F.repeat(F.lit(sign), n).cast("binary")
    one = lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))

    def over(c: Column) -> Column:
        at = lambda x: x.start - c.low + 1
        mark = lambda x: F.concat(written("S", F.lit(1)), written("x", x.end - x.start - 1))

        def take(held: Column, x: Column) -> Column:
            free = F.substring(held, at(x), x.end - x.start) == written("-", x.end - x.start)
            return F.when(free, F.overlay(held, mark(x), at(x))).otherwise(held)

        def kept(held: Column) -> Column:
            def whole(x: Column) -> Column:
                after = F.substring(held, x.end - c.low + 1, F.lit(1))
                return (F.substring(held, at(x), x.end - x.start) == mark(x)) & (after != written("x", F.lit(1)))

            return F.array_sort(F.transform(F.filter(c.spans, whole), one))

        return let(F.aggregate(c.spans, written("-", c.high - c.low), take), kept)

    low, high = F.array_min(F.transform(spans, lambda x: x.start)), F.array_max(F.transform(spans, lambda x: x.end))
    return let(F.struct(spans.alias("spans"), low.alias("low"), high.alias("high")), over)


class Selector:
    """Fitted trees, thresholds by generator and digit counts of positives, as a column expression."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[bool, float], sizes: list[int]) -> None:
        self.trees, self.weights, self.thresholds, self.sizes = trees, weights, thresholds, sizes

    def score(self, of: Callable[[str], Column]) -> Column:
        """Probability that a proposal is a fixed span."""
        terms = [as_column(t, FEATURES, of) * w for t, w in zip(self.trees, self.weights)]
        return 1 / (1 + F.exp(-2 * reduce(Column.__add__, terms)))

    def selected(self, free: Column, address: bool, cut: Column) -> Column:
        """Spans (start, end), in order, of the proposals that reach the threshold; of those that overlap the best.

        Where spans are cut from a run (``cut``: by a fixed one), what is left may be of a fixed format by itself; it is selected too.
        """
        if address not in self.thresholds:
            return F.array().cast(SPANS)

        def ranked(x: Column) -> Column:
            def of(f: Column) -> Column:
                nearest = F.array_min(F.transform(F.array(*map(F.lit, self.sizes)), lambda n: F.abs(n - f.digits)))
                end = x.start + F.length(x.m)
                loss = -self.score(f.getField)
                alone = F.lit(False) if address else reduce(Column.__or__, [x.m.rlike(f"^(?:{PATTERNS[k]})$") & valid(k, x.m) for k in KINDS[1:]])
                return F.struct((-loss < self.thresholds[address]).alias("late"), alone.alias("alone"), loss.alias("loss"), nearest.alias("far"), (-F.length(x.m)).alias("short"), x.start.alias("start"), end.alias("end"))

            return let(F.struct(*[v.alias(n) for n, v in features(x, address).items()]), of)

        def without_overlaps(best: Column) -> Column:
            # Left-overs count only beside a fixed span or a proposal that reaches the threshold, which comes first.
            none = (F.size(best) == 0) | (~cut & F.get(best, 0).late)
            return F.when(none, F.array().cast(SPANS)).otherwise(best_first(best))

        reaching = F.filter(F.transform(free, ranked), lambda x: ~x.late | x.alone)
        return F.when(F.size(free) == 0, F.array().cast(SPANS)).otherwise(let(F.array_sort(reaching), without_overlaps))


def fit(documents: DataFrame, text: str = "text") -> Selector:
    by_features = ["label", *FEATURES]
    # In a fixed order, so that reruns add up in the same one.
    rows = cut_lineage(training_rows(documents, text).repartition(4, *by_features).sortWithinPartitions(*by_features))
    labels = {r.label for r in rows.select("label").distinct().collect()}
    if 1 not in labels:
        return Selector([], [], {}, [])
    sizes = rows.filter("label = 1").groupBy(F.col("digits").cast("int").alias("n")).agg(F.sum("weight").alias("count")).orderBy(F.desc("count"), "n").limit(SIZES)
    selector = Selector([], [], {}, [r.n for r in sizes.collect()])
    if labels == {1}:  # nothing to tell apart: every proposal counts
        selector.score = lambda of: F.lit(1.0)
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        combinations = rows.count()
        bins = BINS if combinations <= SPLIT_ROWS else math.isqrt(combinations) + 1  # so many that splits are looked for in all rows
        model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=7).fit(vectors)
        selector.trees, selector.weights = [t._java_obj.rootNode() for t in model.trees], list(model.treeWeights)
    scored = rows.filter("label = 1").groupBy("address").agg((F.sum(selector.score(F.col) * F.col("weight")) / F.sum("weight")).alias("mean"))
    selector.thresholds = {bool(r.address): r["mean"] / 2 for r in scored.collect()}
    return selector


def span_arrays(p: Column, selector: Selector) -> dict[str, Column]:
    """Arrays of (start, end) by kind, from ``proposals``."""
    flat = lambda where, k: F.flatten(F.transform(where, lambda x: x.getField(k)))

    cut = lambda x, address: F.lit(False) if address else sum((F.size(x.getField(k)) for k in KINDS[1:]), F.lit(0)) > 0
    extra = lambda where, address: F.flatten(F.transform(where, lambda x: selector.selected(x.free, address, cut(x, address))))

    return {
        "email": flat(p.addresses, "email"),
        **{k: flat(p.numbers, k) for k in KINDS[1:]},
        "number": extra(p.numbers, False),
        "address": extra(p.addresses, True),
    }


def spans(documents: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """Replaces ``text`` by arrays of (start, end): email, ip, card, phone, number, address."""
    keep = [c for c in documents.columns if c not in (text, *KINDS, "number", "address")]
    found = documents.select(*keep, proposals(F.coalesce(F.col(text), F.lit(""))).alias("_p"))
    return found.select(*keep, *[c.alias(k) for k, c in span_arrays(F.col("_p"), selector).items()])


def highest_before(numbers: Column) -> Column:
    """Largest of the elements before each element, over blocks and inside a block; -1 before the first."""
    most = lambda values: F.aggregate(values, F.lit(-1), lambda a, b: F.greatest(a, b))

    def placed(held: Column) -> Column:
        block = lambda i: (i / BLOCK).cast("int")
        inside = lambda i: most(F.slice(held.l, block(i) * BLOCK + 1, i % BLOCK))
        return F.transform(held.l, lambda _, i: F.greatest(F.element_at(held.b, block(i) + 1), inside(i)))

    tops = F.transform(
        F.sequence(F.lit(0), (F.size(numbers) / BLOCK).cast("int")), lambda j: most(F.slice(numbers, j * BLOCK + 1, F.lit(BLOCK)))
    )
    blocks = let(tops, lambda s: F.transform(s, lambda _, j: most(F.slice(s, F.lit(1), j))))
    return let(F.struct(numbers.alias("l"), blocks.alias("b")), placed)


def merged(found: Column) -> Column:
    """(start, end, kind) of overlapping spans as one: from the first start to the last end, kind of the first, longest one."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), s.place.alias("place"), s.kind.alias("kind"))))

    def joined(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: -s.back)
        reach = let(ends, highest_before)
        heads = F.filter(F.zip_with(spans, reach, lambda s, r: F.struct(s.start.alias("start"), s.kind.alias("kind"), r.alias("reach"))), lambda h: h.start >= h.reach)
        return let(
            F.struct(heads.alias("h"), F.array_max(ends).alias("last")),
            lambda c: F.transform(
                c.h, lambda h, i: F.struct(h.start.alias("start"), F.coalesce(F.get(c.h, i + 1).reach, c.last).alias("end"), h.kind.alias("kind"))
            ),
        )

    return let(ordered, joined)


def _cut(text: Column, found: Column) -> Column:
    """The text with the spans (merged, in order) replaced by their kind in brackets.

    Pieces are taken from chunks of the text, so that a piece far into a long text is not counted from its start.
    """

    def rebuilt(c: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = (start / CHUNK).cast("int")
            near = F.array_join(F.slice(c.chunks, first + 1, ((end - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(near, start % CHUNK + 1, end - start)).otherwise("")

        mark = lambda s: F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))
        since = lambda i: F.coalesce(F.get(c.spans, i - 1).end, F.lit(0))
        parts = F.transform(c.spans, lambda s, i: F.concat(piece(since(i), s.start), mark(s)))
        return F.concat(F.array_join(parts, ""), piece(since(F.size(c.spans)), F.length(c.text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))
    return let(F.struct(text.alias("text"), found.alias("spans"), chunks.alias("chunks")), rebuilt)


def redacted(documents: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """``documents`` with every span of ``text`` that ``spans`` finds replaced by its kind in brackets; null stays null.

    All spans are those of the original text; overlapping ones become one before the text is cut.
    """

    kinds, value = [*KINDS, "number", "address"], F.col(text)
    name = "_found"
    while name in documents.columns:
        name += "_"

    def listed(arrays: dict[str, Column]) -> Column:
        named = lambda n, k: F.transform(
            arrays[k], lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(n).alias("place"), F.lit(k).alias("kind"))
        )
        return F.concat(*[named(n, k) for n, k in enumerate(kinds)])

    # Step by step: lambdas in lambdas would be too deep for the analyzer.
    found = documents.withColumn(name, proposals(F.coalesce(value, F.lit(""))))
    found = found.withColumn(name, F.struct(*[c.alias(k) for k, c in span_arrays(F.col(name), selector).items()]))
    found = found.withColumn(name, listed({k: F.col(name).getField(k) for k in kinds}))
    clean = F.when(F.size(name) == 0, value).otherwise(let(F.struct(value.alias("t"), F.col(name).alias("s")), lambda c: _cut(c.t, merged(c.s))))
    return found.withColumn(text, clean).drop(name)


def span_list(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind, then start, joined by commas."""
    one = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s.start.cast("string"), s.end.cast("string")))
    return F.array_join(F.concat(*map(one, kinds)), ",")


def document_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans(documents, fit(documents))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_list(KINDS), 256).alias("base_sha256"),
        span_list([*KINDS, "number", "address"]).alias("spans"),
    )
