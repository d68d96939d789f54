"""Removes lines that match an earlier line, by an exact set-similarity join made of DataFrame operations alone.

A line is its set of tokens (words between ASCII space characters). Two lines match if the Jaccard similarity of
their sets is at least ``threshold``; a line goes if it matches any line before it, in the order of doc_id, then line
number. The join never meets all pairs:

* Lines are cut into words once; the hashes of their sets are kept on disk, then counted and ordered from there.
* Equal sets are one row, combined before the shuffle; only a set's first line can stay.
* Tokens are ordered by rarity, from counts of the lines that have them (in RARITY_SLOTS slots of a hash, so that the
  counts have a fixed size), then by hash. Matching lines share a token among the first ``n - ceil(threshold * n) + 1`` of each:
  the prefix, one row per token.
* Rows of one token meet if their sizes allow a match, their places in the prefix leave enough tokens for it, and
  their parity sketches differ in no more bits than matching sets may. None of these drops a match. Both sides of this
  join read one shuffle, and it is by token and class of size: a row goes to its own class and to those of the larger
  sets that its place in the prefix lets it match.
* A semi-join over sketches of 128 bits finds the lines that have such a partner at all; only these are numbered in
  order of place and read again, as whole token sets with sketches of 256 bits.
* Of these, lines that match the likest fitting leader (a token's first line of each size) go at once, then those that
  match the likest line at all that may match them. Those that are left meet all earlier ones. So a cluster of similar lines
  takes rows in proportion to its size.
* What meets is verified on the whole sets.

Tokens are compared by 57 bits of hash, sets, when equal, by 128, and rows of one doc_id are told apart by 128.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, stash, text_key

THRESHOLD = 0.8
RARITY_SLOTS = 2**16
#: Not read any more, for words of all texts are counted line by line; kept for those that set it.
LONG = 2**20
#: How many times the least size of a class the next one's is.
CLASS_RATIO = 1.5
LAST_ID = 2**63 - 1
#: The signs between words, all made spaces.
GAPS, SPACES = "\t\x0b\x0c\r", "    "
PLACE = ["did", "key", "line"]


def _spaced(text: Column) -> Column:
    """A text with spaces for all signs between words but line feeds; most texts have no others, and are not translated."""
    found = F.contains(text, F.lit(GAPS[0]))
    for sign in GAPS[1:]:
        found = found | F.contains(text, F.lit(sign))
    return F.when(found, F.translate(text, GAPS, SPACES)).otherwise(text)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds did (a null id counts as the greatest one) and key, which tells apart rows of one did."""
    return docs.withColumns({"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "key": text_key()})


def _lines(rows: DataFrame) -> DataFrame:
    """The place and spaced text of each line that has tokens."""
    lines = rows.select("did", "key", F.posexplode(F.split(_spaced(F.coalesce(F.col("text"), F.lit(""))), "\n")).alias("line", "text"))
    return lines.filter(F.trim("text") != "")


def _hashes(text: str) -> Column:
    """The hashes of a spaced line's different words."""
    found = F.array_distinct(F.transform(F.split(text, " "), lambda w: F.xxhash64(w)))
    return F.array_remove(found, F.xxhash64(F.lit("")))


def _counts(hashed: DataFrame) -> np.ndarray:
    """In how many lines' sets tokens of each slot occur: RARITY_SLOTS counts at most go to the driver."""
    tokens = hashed.select(F.explode("hashes").alias("h"))
    found = tokens.groupBy(_slot(F.col("h")).cast("int").alias("slot")).count().toArrow()
    counts = np.zeros(RARITY_SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("count").to_numpy()
    return counts


def _ranks(counts: np.ndarray) -> np.ndarray:
    """About twice log2 of each count."""
    return np.minimum(np.floor(np.log2(np.maximum(counts, 1)) * 2), 63).astype(np.int64)


def _looked_up(ranks: np.ndarray) -> Column:
    """The ranks in the plan, as an array: in the lambda that reads them each step counts, and this takes the fewest."""
    return F.split(F.lit(",".join(map(str, ranks.tolist()))), ",").cast("array<bigint>")


def rarity(docs: DataFrame) -> Column:
    """A number for each slot of the tokens' hash: about twice log2 of how many lines of all texts have tokens there."""
    return _looked_up(_ranks(_counts(_hashed(_lines(_keyed(docs))))))


def _edges(counts: np.ndarray, parts: int) -> list[int]:
    """Codes that part the tokens of all lines into ``parts`` of about like number; each is above the one before."""
    mass = np.bincount(_ranks(counts), weights=counts, minlength=64)
    below = np.cumsum(mass)
    found: list[int] = []
    for k in range(1, parts):
        want = below[-1] * k / parts
        rank = int(np.searchsorted(below, want))
        share = 1 - (below[rank] - want) / mass[rank] if mass[rank] else 0
        found.append(max((rank << 57) + int(min(share, 0.999) * 2**57), found[-1] + 1 if found else 0))
    return found


def _slot(h: Column) -> Column:
    """A place from 0 to RARITY_SLOTS - 1."""
    return h.bitwiseAND(F.lit(RARITY_SLOTS - 1))


def _coded(hashed: DataFrame, ranks: Column) -> DataFrame:
    """Adds token codes in order of rarity: 6 bits of rank above 57 bits of hash. None is null, which coalesce tells Spark:
    arrays without nulls are sorted as plain numbers."""

    def code(h: Column) -> Column:
        return F.coalesce(F.shiftleft(F.get(ranks, _slot(h)), 57).bitwiseOR(h.bitwiseAND(F.lit(2**57 - 1))), F.lit(0).cast("long"))

    return hashed.withColumn("codes", F.sort_array(F.transform("hashes", code)))


def _ceil(share: float, n: Column) -> Column:
    """ceil(share * n), the last bits of the product aside."""
    return F.ceil(n * F.lit(share) - F.lit(1e-9)).cast("int")


#: Words of the parity sketches: of all lines, and of those that may match another one.
COARSE, FINE = ("t0", "t1"), ("t0", "t1", "t2", "t3")


def _hashed(lines: DataFrame) -> DataFrame:
    """The hashes of the lines' tokens in place of the text."""
    return lines.withColumn("hashes", _hashes("text")).drop("text")


def _described(lines: DataFrame, ranks: Column, threshold: float, sketches: tuple[str, ...]) -> DataFrame:
    """The lines' token codes, their number n, parity sketches and the prefix, in place of the text."""
    edges = [k * 2**64 // len(sketches) - 2**63 for k in range(1, len(sketches))]
    return _prefixed(_sketched(_coded(_hashed(lines), ranks), "hashes", edges, sketches).drop("hashes"), threshold)


def _prefixed(coded: DataFrame, threshold: float) -> DataFrame:
    n = F.col("n")
    return coded.withColumn("prefix", F.slice("codes", F.lit(1), n - _ceil(threshold, n) + 1))


def _sketched(coded: DataFrame, name: str, edges: list[int], sketches: tuple[str, ...]) -> DataFrame:
    """Adds n and words of parity, each of the numbers of array ``name`` between two edges; the array becomes sorted.

    Numbers are sorted with the edges among them, so that each goes through one lambda, however many words there are.
    The ranges' sizes give n, so Spark, which repeats no costly column, makes each range once, in compiled code.
    """
    marks = [F.lit(e).cast("long") for e in edges]
    places = {f"{word}_end": F.array_position(name, e).cast("int") for word, e in zip(sketches, marks, strict=False)}
    ranged = coded.withColumn(name, F.sort_array(F.concat(name, F.array(*marks)))).withColumns(places)
    ends = [F.lit(0), *(F.col(place) for place in places), F.size(name) + 1]
    ranges = {f"{word}_range": F.slice(name, low + 1, high - low - 1) for word, low, high in zip(sketches, ends[:-1], ends[1:], strict=True)}
    n = sum((F.size(word) for word in ranges), F.lit(0))
    parities = {word: _parity(F.col(f"{word}_range")) for word in sketches}
    ranged = ranged.withColumns(ranges).withColumns({"n": n} | parities)
    return ranged.withColumn(name, F.concat(*ranges)).drop(*places, *ranges)


def _parity(hashes: Column) -> Column:
    """A bit for each of 64 slots of some hashes, by their last bits: whether an odd number falls there."""

    def flip(a: Column, h: Column) -> Column:
        return a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(hashes, F.lit(0).cast("long"), flip)


def _tokens(lines: DataFrame, sketches: tuple[str, ...]) -> DataFrame:
    """A row for each token of the prefix, by 31 bits."""
    tokens = lines.select("number", "n", *sketches, F.posexplode("prefix").alias("i", "code"))
    return tokens.select("number", "n", *sketches, "i", F.col("code").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("token"))


def _differ(sketches: tuple[str, ...]) -> Column:
    return sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in sketches), F.lit(0))


def _fits(threshold: float, sketches: tuple[str, ...]) -> Column:
    """What rows a and b of one prefix token must satisfy if it is the first token that matching sets share.

    Of n and m tokens, matching sets share c * (n + m) at least. As bits that differ are even in number if n + m is, no
    product need be rounded.
    """
    n, m = F.col("a.n"), F.col("b.n")
    need = (n + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)
    return (F.col("a.token") == F.col("b.token")) & (n - F.col("a.i") >= need) & (m - F.col("b.i") >= need) & (_differ(sketches) <= n + m - need * 2)


def _classed(tokens: DataFrame, threshold: float) -> DataFrame:
    """The tokens' rows with the size ``most`` of the largest set that may match from place i, once for each class of
    sizes from the set's own to that one's; the token has the class above its bits.

    Of two sets that match, the smaller one goes to the class of the larger one, so all matches meet there.
    """
    n, bits = F.col("n"), F.lit(31)
    most = F.floor((n - F.col("i")) * F.lit((1 + threshold) / threshold) - n + F.lit(1e-6)).cast("int")

    def size_class(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / F.lit(math.log(CLASS_RATIO))).cast("int")

    rows = tokens.withColumn("most", most).withColumn("c", F.explode(F.sequence(size_class(n), size_class(F.greatest(n, "most")))))
    return rows.withColumn("token", F.call_function("shiftleft", F.col("c").cast("long"), bits).bitwiseOR(F.col("token"))).drop("c", "i")


def _fits_class(threshold: float, sketches: tuple[str, ...]) -> Column:
    """_fits for rows of classes, in as few steps as can be: this is asked of all rows of a token."""
    n, m = F.col("a.n"), F.col("b.n")
    likely = (F.col("a.token") == F.col("b.token")) & (m <= F.col("a.most")) & (n <= F.col("b.most"))
    return likely & (_differ(sketches) <= (n + m) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6))


def _verified(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """The numbers a of lines that match their b, on whole sets."""
    found = pairs
    for side in ("a", "b"):
        found = found.join(lines.select(F.col("number").alias(side), F.col("codes").alias(f"{side}_codes")), side)
    both = F.size(F.array_intersect("a_codes", "b_codes"))
    union = F.size("a_codes") + F.size("b_codes") - both
    return found.filter(both / union >= F.lit(threshold)).select(F.col("a").alias("number")).distinct()


def _sets(described: DataFrame) -> DataFrame:
    """One row for each different set: its first line's place, what describes it, and a number."""
    return stash(
        described.groupBy("x", "y")
        .agg(F.min(F.struct(*PLACE, "n", *COARSE, "prefix")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select(
            F.monotonically_increasing_id().alias("number"), "first.*",
            F.when(F.col("copies") > 1, F.col("x")).alias("x"), F.when(F.col("copies") > 1, F.col("y")).alias("y"),
        )
    )


def _equal_lines(described: DataFrame, sets: DataFrame) -> DataFrame:
    """The places of lines whose set an earlier line has."""
    firsts = sets.filter("x is not null").select("x", "y", F.struct(*PLACE).alias("first"))
    return described.select(*PLACE, "x", "y").join(firsts, ["x", "y"]).filter(F.struct(*PLACE) > F.col("first")).select(*PLACE)


def _partners(sets: DataFrame, threshold: float) -> DataFrame:
    """did, key, lines and numbers, in arrays, of first lines with a partner that may match them; numbers are in the order
    of places."""
    tokens = _classed(_tokens(sets, COARSE), threshold)
    met = tokens.alias("a").join(tokens.alias("b"), _fits_class(threshold, COARSE) & (F.col("a.number") != F.col("b.number")), "left_semi")
    places = stash(sets.join(met.select("number").distinct(), "number", "left_semi").select(*PLACE))
    ordered = places.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).withColumn("number", F.monotonically_increasing_id())
    found = ordered.groupBy("did", "key").agg(F.sort_array(F.collect_list(F.struct("line", "number"))).alias("found"))
    return stash(found.select("did", "key", F.col("found.line").alias("lines"), F.col("found.number").alias("numbers")))


def _likest(met: DataFrame) -> DataFrame:
    """Of each a, the b whose sketch differs least; the first of such."""
    least = F.min(F.shiftleft(_differ(FINE).cast("long"), 54).bitwiseOR(F.col("b.number")))
    return met.groupBy(F.col("a.number").alias("a")).agg(least.bitwiseAND(F.lit(2**54 - 1)).alias("b"))


def _similar_lines(lines: DataFrame, threshold: float) -> DataFrame:
    """The places of lines that match an earlier one of ``lines``: first those that match the likest of the leaders that
    may match them, then those that match the likest line at all that may, then all others."""
    fits = _fits(threshold, FINE) & (F.col("b.number") < F.col("a.number"))

    leaders = _tokens(lines, FINE).groupBy("token", "n").agg(F.min(F.struct("number", "i", *FINE)).alias("b")).select("token", "n", "b.*")
    left, gone = lines, None
    for others in (leaders, _tokens(lines, FINE)):  # of each line's partners, the most similar alone
        met = _tokens(left, FINE).alias("a").join(others.alias("b"), fits)
        found = stash(_verified(_likest(met), lines, threshold))
        gone = found if gone is None else gone.unionByName(found)
        left = lines.join(gone, "number", "left_anti")
    rest = _tokens(left, FINE).alias("a").join(_tokens(lines, FINE).alias("b"), fits)
    rest = rest.select(F.col("a.number").alias("a"), F.col("b.number").alias("b")).distinct()
    gone = gone.unionByName(_verified(rest, lines, threshold))
    return lines.select("number", *PLACE).join(gone, "number", "left_semi").select(*PLACE)


def line_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with n_lines, removed (its removed lines' numbers, from 0) and its text without them.

    Lines end at line feeds; those without tokens stay. Null texts are one empty line and become empty. A null doc_id
    is the last of all. Rows that repeat a doc_id with one text have the same places: they do not remove each other's
    lines, and are treated alike. Texts and lines of any length are taken whole. An empty table gives no rows. Columns
    named n_lines or removed give way, all others stay.
    """
    others = [c for c in docs.columns if c not in ("text", "n_lines", "removed")]
    # words cost more to cut than hashes to read; these hardly pack, and are slower to write as Parquet
    hashed = _hashed(_lines(_keyed(docs.select("doc_id", "text")))).persist(StorageLevel.DISK_ONLY)
    counts = _counts(hashed)
    ranks = _looked_up(_ranks(counts))
    coded = _sketched(_coded(hashed, ranks).drop("hashes"), "codes", _edges(counts, len(COARSE)), COARSE)
    names = F.xxhash64("codes").alias("x"), F.xxhash64(F.lit(1), "codes").alias("y")
    described = stash(_prefixed(coded, threshold).select(*PLACE, *names, "n", *COARSE, "prefix"), "snappy")
    hashed.unpersist(True)
    sets = _sets(described)
    equal = stash(_equal_lines(described, sets))
    discard(described)
    found = _partners(sets, threshold)
    discard(sets)
    # the hints: found and gone have a row a document, so that texts need not be sorted to meet them
    whole = _keyed(docs.select(F.struct(*others).alias("rest"), "doc_id", "text")).drop("doc_id").repartition("did", "key")
    again = whole.join(found.hint("shuffle_hash"), ["did", "key"])
    again = again.select("did", "key", "lines", "numbers", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line", "text"))
    at = F.array_position("lines", F.col("line"))
    again = again.filter(at > 0).select(*PLACE, F.get("numbers", at.cast("int") - 1).alias("number"), "text")
    lines = stash(_described(again, ranks, threshold, FINE))
    gone = equal.unionByName(_similar_lines(lines, threshold))
    gone = stash(gone.groupBy("did", "key").agg(F.sort_array(F.collect_set("line")).alias("removed")))
    text = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    removed = F.coalesce(F.col("removed"), F.array().cast("array<int>"))
    kept = F.filter(text, lambda _, k: ~F.array_contains("removed", k))
    return whole.join(gone.hint("shuffle_hash"), ["did", "key"], "left").select(
        "rest.*",
        F.when(F.col("removed").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(text).cast("long").alias("n_lines"),
        removed.alias("removed"),
    )
