"""N-gram Jaccard join: exact similarity links between the word-shingle sets of documents, as components.

The join keeps links exact while it skips work by relations among sets and inside index lists:

1. Sets that are equal collapse into a class; its smallest doc_id stands for it.
2. Shingles are counted over all documents. Batches of texts count their own first, so a shingle of a third of
   all rows sends one entry a batch. A set's prefix, rarest shingles first, is all that is indexed, and shingles
   of one document need no entry: most documents drop out here.
3. Star step: each index list has a head, and a set is compared with the one head, of another component, that most of
   its lists share. It is repeated with other heads on the lists that still mix components. Of a group of near copies
   this finds nearly all links with a comparison a set and round, and gives each set a *leader* with a known distance.
4. Lists whose members are in one component are done. The rest are cut into blocks by set size and by the
   position that the shingle has in the set; pairs of blocks that cannot reach the overlap, given the sizes and
   positions, are skipped whole, as are pairs of blocks of one component.
5. The pairs that remain get their answers from those of their leaders: with the distance of two leaders known,
   the triangle inequality on symmetric differences settles some; for the others the leader's overlap is computed once, and
   each set that it leads corrects it by the few members in which the two differ. Where a large component is involved,
   only the pair of components is noted, and their sets are compared in blocks.

No pair within a component is formed on purpose, and no partner or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.components import joined_components
from barwright.llm.shared_tokens import MOST_SETS, shared_tokens
from barwright.llm.textarrays import U64, binary, mix, per_text_sets, shingles, slices
from barwright.plans.shared import stage

#: Shingles of a batch that are counted before they are sent, and of a bucket (about) that are counted together.
BATCH_SHINGLES, BUCKET_SHINGLES = 1_000_000, 1_500_000
#: Entries of an index block (about).
BLOCK = 256
#: Times that sets are compared with heads of lists, at most; another round follows while the pairs that are left in
#: mixed lists fall to this share.
STAR_ROUNDS, ENOUGH = 12, 0.7
#: Pairs of components with more pairs of members than this are compared block by block, others pair by pair; bytes of a block.
PAIRWISE, BLOCK_BYTES = 64, 256 << 10


def prefix_length(n, num: int, den: int):
    """Members of a set of n, in any order common to all sets, of which every partner shares at least one."""
    return n - -(-n * num // den) + 1


def _signed(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the members of every set: equal sets, and in effect only those, have equal pairs."""
    sums = [np.concatenate([[U64(0)], np.cumsum(mix(sets ^ U64(c)))]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return tuple((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            sets, first = per_text_sets(*shingles(t, k))
            s1, s2 = _signed(sets, first)
            yield pa.RecordBatch.from_arrays([t.rows.column("doc_id"), pa.array(np.diff(first)), pa.array(s1), pa.array(s2)], ["doc_id", "n", "s1", "s2"])

    return run


def _batches_of_sets(batches, k: int, most: int):
    """Distinct sets of consecutive texts, until they have ``most`` shingles: signatures, sizes, shingles."""
    ids, sizes, toks, total, known = [], [], [], 0, set()
    for t in slices(batches):
        sets, first = per_text_sets(*shingles(t, k))
        valid = t.rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        s1, s2 = _signed(sets, first)
        for i in range(len(t)):
            n = int(first[i + 1] - first[i])
            if not n or not valid[i] or (sign := (int(s1[i]), int(s2[i]))) in known:
                continue
            known.add(sign)
            ids.append(sign)
            sizes.append(n)
            toks.append(sets[first[i] : first[i + 1]])
            total += n
            if total >= most or len(ids) >= MOST_SETS:
                yield np.array(ids, np.int64), np.array(sizes), np.concatenate(toks)
                ids, sizes, toks, total, known = [], [], [], 0, set()
    if ids:
        yield np.array(ids, np.int64), np.array(sizes), np.concatenate(toks)


def _index(num: int, den: int):
    """One batch: the entries of its sets' prefixes, shingles that nobody else has left out."""

    def run(ids, sizes, who, tok, df) -> pa.Table:
        order = np.lexsort((tok, df, who))
        tok, who = tok[order], who[order]
        shared = np.bincount(who, minlength=len(ids))
        first = np.cumsum(shared) - shared
        pos = np.arange(len(tok)) - first[who] + (sizes - shared)[who]
        keep = pos < prefix_length(sizes, num, den)[who]
        tok, who, pos = tok[keep], who[keep], pos[keep]
        return pa.table({"tok": pa.array(tok.view(np.int64)), "s1": pa.array(ids[who, 0]), "s2": pa.array(ids[who, 1]), "n": pa.array(sizes[who]), "pos": pa.array(pos.astype(np.int32))})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in slices(batches):
            sets, first = per_text_sets(*shingles(t, k))
            s1, s2 = _signed(sets, first)
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(first)), pa.array(s1), pa.array(s2), binary(sets[first[i] : first[i + 1]] for i in range(len(t)))], ["n", "s1", "s2", "items"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.zeros(batch.num_rows, np.int64)
        left, right = batch.column("x"), batch.column("y")
        for i in range(batch.num_rows):
            got[i] = len(np.intersect1d(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), assume_unique=True))
        sizes = [pa.array([len(v.as_buffer()) // 8 for v in c], pa.int64()) for c in (left, right)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got), *sizes], ["a", "b", "overlap", "na", "nb"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlap of every pair (a, b) of documents: (a, b, overlap, na, nb)."""
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_overlaps, "a long, b long, overlap long, na long, nb long")


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a set has more and less than its leader."""
    for b in batches:
        own, head = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(c)] for c in ("own", "head"))
        sides = [binary(np.setdiff1d(x, y, assume_unique=True) for x, y in zip(*pair, strict=True)) for pair in ((own, head), (head, own))]
        yield pa.RecordBatch.from_arrays([b.column("a"), pa.array([len(x) for x in own], pa.int64()), *sides], ["a", "na", "more", "less"])


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of a set with another: its leader's, and what the changes add and take away."""
    for b in batches:
        got, sizes = b.column("head_overlap").to_numpy().copy(), np.zeros(b.num_rows, np.int64)
        for i in range(b.num_rows):
            other, more, less = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in ("items", "more", "less"))
            for change, sign in ((more, 1), (less, -1)):
                at = np.minimum(np.searchsorted(other, change), len(other) - 1)
                got[i] += sign * int((other[at] == change).sum())
            sizes[i] = len(other)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(got), b.column("na"), pa.array(sizes)], ["a", "b", "overlap", "na", "nb"])


def derived(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlaps of ``pairs(a, b, la)`` from those of la, the leader of a, with b: (a, b, overlap, na, nb).

    A leader is compared with b once for all sets that it leads; these differ from it in few members, and only those
    are looked up in b. A set without a leader is its own.
    """
    heads = stage(overlaps(pairs.select(F.col("la").alias("a"), "b").distinct(), sets).select(F.col("a").alias("la"), "b", F.col("overlap").alias("head_overlap")), "answers")
    led = pairs.select("a", "la").distinct().join(sets.toDF("a", "own"), "a").join(sets.toDF("la", "head"), "la")
    changes = stage(led.select("a", "own", "head").mapInArrow(_changes, "a long, na long, more binary, less binary"), "changes")
    rows = pairs.join(heads, ["la", "b"]).join(changes, "a").join(sets.toDF("b", "items"), "b")
    return rows.select("a", "b", "na", "head_overlap", "more", "less", "items").mapInArrow(_corrected, "a long, b long, overlap long, na long, nb long")


def _block_pairs(num: int, den: int):
    """Within two blocks of an index list, the pairs of different components that sizes and positions allow: as members
    (a, b), or where the two components have many members, as the components (p, q) alone, p the smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = [[np.array([e[c] for e in row[side]], np.int64) for c in ("cid", "n", "pos", "label", "size")] for side in ("e1", "e2")]
                (n1, p1, l1), (n2, p2, l2) = [v[:, None] for v in ends[0][1:4]], [v[None, :] for v in ends[1][1:4]]
                # no shingle before the first common one is common: the overlap has at most this and what follows
                fits = (l1 != l2) & (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2)) & ((num + den) * np.minimum(n1 - p1, n2 - p2) >= num * (n1 + n2))
                i, j = np.nonzero(fits)
                if not len(i):
                    continue
                (a, _, _, p, x), (b, _, _, q, y) = (v[i] for v in ends[0]), (v[j] for v in ends[1])
                many = x * y > PAIRWISE
                turned = (x > y) | (x == y) & (p > q)
                both = np.unique(np.stack([np.where(turned, q, p), np.where(turned, p, q)], axis=1)[many], axis=0)
                few = ~many
                m, k = int(few.sum()), len(both)
                cells = [pa.array(np.minimum(a, b)[few]), pa.array(np.maximum(a, b)[few])]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([c, pa.nulls(k, pa.int64())]) for c in cells] + [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(both[:, c])]) for c in (0, 1)], ["a", "b", "p", "q"])

    return run


def _met(num: int, den: int):
    """Links between two blocks of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                mine, theirs = batch.column("mine")[r].as_py(), batch.column("theirs")[r].as_py()
                sets = [np.frombuffer(e["items"], np.uint64) for e in theirs]
                sizes = np.array([len(s) for s in sets])
                tok, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(tok, kind="stable")
                tok, owner = tok[order], owner[order]
                a, b = [], []
                for e in mine:
                    own = np.frombuffer(e["items"], np.uint64)
                    low, high = np.searchsorted(tok, own, "left"), np.searchsorted(tok, own, "right")
                    count = high - low
                    at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    common = np.bincount(owner[at], minlength=len(sets))
                    for j in np.flatnonzero((num + den) * common >= num * (len(own) + sizes)):
                        a.append(e["cid"])
                        b.append(theirs[j]["cid"])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _members_met(pairs: DataFrame, members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the members of components p and q, for distinct ``pairs(p, q)``, without a row for a pair of members.

    The members of q, and those of all p that meet q, are dealt into blocks of about ``BLOCK_BYTES`` of sets; each pair of
    blocks is a row, compared as a whole.
    """
    pairs = stage(pairs.distinct(), "components")
    named = members.join(sets, "cid").select("label", "cid", "items")
    of_q = named.join(pairs.select(F.col("q").alias("label")).distinct(), "label").select(F.col("label").alias("q"), "cid", "items")
    of_p = named.join(pairs.withColumnRenamed("p", "label"), "label").select("q", "cid", "items")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        parts = df.groupBy("q").agg(F.ceil(F.sum(F.octet_length("items")) / BLOCK_BYTES).alias("parts"))
        # (dealt by both, since one component may have most of the members)
        dealt = df.join(parts, "q").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).repartition("q", "part")
        return stage(dealt.groupBy("q", "part").agg(F.collect_list(F.struct("cid", "items")).alias(name)).select("q", F.col("part").alias(f"{name}_part"), name), name)

    both = blocks(of_p, "mine").join(blocks(of_q, "theirs"), "q").repartition("q", "mine_part", "theirs_part").select("mine", "theirs")
    return both.mapInArrow(_met(num, den), "a long, b long")


def _named(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The index with each set's component so far."""
    if labels is None:
        return index.withColumn("label", F.col("cid"))
    return index.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def jaccard_components(docs: DataFrame, num: int = 4, den: int = 5, k: int = 5, bucket_shingles: int = BUCKET_SHINGLES, batch_shingles: int = BATCH_SHINGLES, tally: dict | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    A document's set has its distinct ``k``-word shingles (words: runs of non-blank characters, A-Z
    lower-cased); with fewer words the whole sequence is the one member; with no word, or a null text, the set is
    empty and links with nothing. Two documents link when intersection / union >= num / den. component_id is the
    smallest doc_id that links reach, the document's own included.

    Repeated rows, and rows that share a doc_id, are one node with the links of all its texts. A null doc_id
    cannot be named: such rows report their n_shingles and a null component_id, and link nothing. Columns other
    than the two are not looked at, so their names cannot clash. No rows give no rows. ``tally``, if given, is filled with the
    numbers of pairs that each way has settled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = stage(docs.mapInArrow(_signatures(k), "doc_id long, n long, s1 long, s2 long"), "signatures")
    classes = signs.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_shingles), min(total // 4096, 64))

    index = shared_tokens(docs, lambda it: _batches_of_sets(it, k, batch_shingles), buckets, _index(num, den), "tok long, s1 long, s2 long, n long, pos int")
    key = ["n", "s1", "s2"]
    index = stage(index.distinct().join(classes, key).select("tok", "cid", "n", "pos"), "prefixes")

    lists = index.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1").select("tok")
    index = index.join(lists, "tok")
    # the part of its prefix that a set shares: near 1 in the middle of a group of near copies, less with every change
    central = index.groupBy("cid").agg((F.count("*") / (F.max("n") * (den - num) / den + 1)).alias("central"))
    index = stage(index.join(central, "cid"), "lists")
    wanted = stage(index.select("cid").distinct().join(classes, "cid"), "wanted")
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = texts.mapInArrow(_sets(k), "n long, s1 long, s2 long, items binary").join(wanted, key).select("cid", "items")
    chosen = stage(chosen.dropDuplicates(["cid"]), "sets")
    link = f"{num + den} * overlap >= {num} * (na + nb)"
    checked, labels, before = None, None, None
    for turn in range(STAR_ROUNDS):
        named = _named(index, labels)
        # first the most central member of each list, then others that are central, drawn anew in every round
        drawn = F.pmod(F.xxhash64("cid", F.lit(turn)), F.lit(1000)) / 1000
        order = F.struct(F.col("central") * (1 - (0.4 * drawn if turn else F.lit(0.0))), "cid")
        lists = named.groupBy("tok", "label").agg(F.count("*").alias("c"), F.max_by(F.struct("label", "cid", "n"), order).alias("head"), F.max(order).alias("o"))
        lists = lists.groupBy("tok").agg(F.max_by("head", "o").alias("head"), F.count("*").alias("labels"), (F.pow(F.sum("c"), F.lit(2)) - F.sum(F.col("c") * F.col("c"))).alias("pairs")).where("labels > 1")
        lists = stage(lists.select("tok", "head", "pairs"), "heads")
        left = lists.agg(F.sum("pairs")).first()[0] or 0
        if not left or turn and left > ENOUGH * before:
            break
        before = left
        met = named.join(lists, "tok").where(f"label <> head.label and {den} * least(n, head.n) >= {num} * greatest(n, head.n)")
        # with the one head that most of its lists share, a set has the best chance to link
        shared = met.groupBy("cid", F.col("head.cid").alias("h")).agg(F.count("*").alias("c"))
        star = shared.groupBy("cid").agg(F.max_by("h", F.struct("c", "h")).alias("h")).select(F.least("cid", "h").alias("a"), F.greatest("cid", "h").alias("b")).distinct()
        found = stage(overlaps(star if checked is None else star.join(checked.select("a", "b"), ["a", "b"], "left_anti"), chosen), "checked")
        checked = found if checked is None else checked.union(found)
        labels = joined_components(labels, found.where(link).select("a", "b"))
    if checked is None:
        checked = stage(overlaps(wanted.where("false").select(F.col("cid").alias("a"), F.col("cid").alias("b")), chosen), "checked")

    # a set's leader: of the heads that it links with, the nearest
    distance = (F.col("na") + F.col("nb") - 2 * F.col("overlap")).alias("d")
    both = checked.where(link).select(F.col("b").alias("cid"), distance, F.col("a").alias("leader"))
    leaders = both.groupBy("cid").agg(F.min(F.struct("d", "leader")).alias("l")).select("cid", "l.leader", "l.d")

    members = stage(_named(wanted.select("cid", "n"), labels), "members")
    sizes = members.groupBy("label").agg(F.count("*").alias("size"))
    named = stage(_named(index, labels).join(sizes, "label"), "named")
    mixed = named.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    size = F.ceil(F.col("m") / BLOCK)
    cut = named.join(mixed.select("tok", F.col("lo").alias("first"), "m"), "tok").withColumns({
        "sb": F.floor(F.ln("n") / float(np.log(den / num)) + 1e-9),  # sizes that link are in one band or in the next
        "pb": F.floor(F.col("pos") * 8 / F.col("n")),
        "own": F.col("label") == F.col("first"),
        "sub": F.pmod(F.xxhash64("cid"), size),
    })
    blocks = cut.groupBy("tok", "sb", "pb", "own", "sub").agg(
        F.collect_list(F.struct("cid", "n", "pos", "label", "size")).alias("e"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max(F.col("n") - F.col("pos")).alias("reach"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    blocks = stage(blocks.withColumn("key", F.struct("sb", "pb", "own", "sub")), "blocks")
    facts = ("e", "key", "n_lo", "n_hi", "reach", "lo", "hi")
    one = blocks.select("tok", *[F.col(c).alias(f"{c}1") for c in facts], F.explode(F.array(F.col("sb"), F.col("sb") + 1)).alias("sb"))
    two = blocks.select("tok", "sb", *[F.col(c).alias(f"{c}2") for c in facts])
    beside = one.join(two, ["tok", "sb"]).where(
        f"""key1 <= key2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2) and {den} * least(n_hi1, n_hi2) >= {num} * greatest(n_lo1, n_lo2)
        and {num + den} * least(reach1, reach2) >= {num} * (n_lo1 + n_lo2)"""
    )
    all_pairs = stage(beside.select("e1", "e2").mapInArrow(_block_pairs(num, den), "a long, b long, p long, q long").distinct(), "pairs")
    met = _members_met(all_pairs.where("a is null").select("p", "q"), members, chosen, num, den)
    pairs = all_pairs.where("a is not null").select("a", "b").join(checked.select("a", "b"), ["a", "b"], "left_anti")
    lead = lambda side: leaders.select(F.col("cid").alias(side), F.col("leader").alias(f"l{side}"), F.col("d").alias(f"d{side}"))
    held = pairs.join(lead("a"), "a", "left").join(lead("b"), "b", "left")
    count = wanted.select("cid", "n")
    held = held.join(count.toDF("a", "na"), "a").join(count.toDF("b", "nb"), "b")
    held = held.select("a", "b", "na", "nb", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), F.coalesce("da", F.lit(0)).alias("da"), F.coalesce("db", F.lit(0)).alias("db"))
    held = stage(held.withColumns({"t1": F.least("la", "lb"), "t2": F.greatest("la", "lb")}), "held")
    tops = overlaps(held.where("t1 <> t2").select(F.col("t1").alias("a"), F.col("t2").alias("b")).distinct(), chosen)
    tops = tops.select(F.col("a").alias("t1"), F.col("b").alias("t2"), (F.col("na") + F.col("nb") - 2 * F.col("overlap")).alias("dl"))
    most = f"(na + nb) - 2 * ceil({num} * (na + nb) / {num + den}.0D - 1e-9)"  # the largest distance of a link
    held = held.join(tops, ["t1", "t2"], "left").withColumn("dl", F.coalesce("dl", F.lit(0)))
    held = stage(held.selectExpr("a", "b", "la", f"case when dl - da - db > {most} then 0 when dl + da + db <= {most} then 1 else 2 end as said"), "derived")
    undecided = stage(held.where("said = 2").select("a", "b", "la"), "undecided")
    exact = stage(derived(undecided, chosen), "exact")
    if tally is not None:
        said = {r["said"]: r["n"] for r in held.groupBy("said").agg(F.count("*").alias("n")).collect()}
        tally |= {"compared with heads": checked.count(), "derived: no link": said.get(0, 0), "derived: link": said.get(1, 0), "derived from the leader's overlap": exact.count(), "pairs of components": all_pairs.where("a is null").count()}

    rows = signs.where("n > 0 and doc_id is not null").join(classes, key).select("doc_id", "n", "cid")
    several = rows.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z")
    several = rows.join(several, "doc_id").select("a", F.col("cid").alias("b"))
    labels = joined_components(labels, held.where("said = 1").select("a", "b").union(exact.where(link).select("a", "b")).union(met).union(several))
    grouped = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(*key, "rep", F.coalesce("label", "cid").alias("label"))
    grouped = stage(grouped, "grouped")
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = grouped.join(least, "label").select(*key, "component_id")
    out = signs.join(final, key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
