"""Secret scan in SQL functions only: fixed patterns, and a randomness test battery for what has no pattern.

The battery takes every run of 20 or more characters that text in an encoding would use, infers the encoding
(decimal, hexadecimal, base 32, base 64), and asks whether its characters could be drawn at random from that alphabet:

- chi-squared uniformity over the alphabet, with the moments that hold for short strings;
- the runs test on the upper and lower half of the alphabet;
- serial correlation of neighbouring characters;
- the pairs of letters: how much likelier the corpus makes them than chance does, in sum, against what letters at random give.

The smallest of the four p-values, corrected for being one of four, tells how random a run looks. A run is reported
if it looks more random than an ordinary run of its length can be expected to. Ordinary runs are identifiers, paths and slugs: words
put together. How random these look is known from decoys: all words of every document, some dozens at a time in the order of the text, are put
together as such names are (cases, hyphens, low lines, slashes, numbers), and each name is cut into pieces of the length of a class. The share of a class's decoys that look at least as random as a run is the
run's p-value against being ordinary, and in each class the false discovery rate among the reported runs
(Benjamini and Hochberg) is held at half of ``rate``; a run that the battery calls not random is not reported either. Where runs are too short for the tests to speak, or decoys too few,
decoys pass as well as runs do, and nothing is reported that way.

Decoys alone cannot tell one key among thousands of ordinary runs, as the least p-value they can give is one in their number. The
other half of ``rate`` goes to a second p-value against being ordinary: how much likelier the run's letter pairs are by chance
than in the corpus. Under the corpus's pairs a ratio of t or more has a probability of 1 / t at most, so 1 / t is the p-value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.plans.shared import stage

#: Fixed values of the base scan: kind, pattern, least characters (of group 2 for assign).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more from AKIA on
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Least length of each length class.
CLASSES = (20, 32, 64)
#: p-values are counted in steps of 1 / STEPS in -ln p, so the table of counts has a fixed bound.
STEPS, MOST_STEPS, MOST_HALVES = 8, 2400, 200


def _running(values: str, zero: str, add: str) -> str:
    """SQL for an array with the total of the items before each of ``values`` (``add`` is a lambda of two): in blocks of the
    square root of their number, so that no array grows item by item."""
    before = lambda a, i: f"transform(sequence(0, size({a}) - 1), {i} -> aggregate(slice({a}, 1, {i}), {zero}, {add}))"
    blocks = "transform(sequence(0, (size(v) - 1) div b), j -> slice(v, cast(j * b + 1 as int), b))"
    sums = f"transform(k, x -> aggregate(x, {zero}, {add}))"
    each = f"flatten(transform(k, (x, j) -> {_bind('array_prepend(x, t[j])', 'y', 'slice(' + before('y', 'm') + ', 2, size(x))')}))"
    body = _bind(sums, "w", _bind(before("w", "n"), "t", each))
    return f"case when size({values}) = 0 then array() else {_bind(values, 'v', _bind('cast(ceil(sqrt(size(v))) as int)', 'b', _bind(blocks, 'k', body)))} end"


_ADD, _MOST = "(s, z) -> s + z", "(s, z) -> greatest(s, z)"


def _found(kind: int, matches: str, pieces: str) -> str:
    """Spans from matches and the text between them: (start, kind, end, token), in code points."""
    lengths = f"transform({matches}, (m, i) -> cast(length({pieces}[i]) + length(m) as bigint))"
    return f"""case when size({matches}) = 0 then array() else {_bind(_running(lengths, '0L', _ADD), 'at', f"transform({matches}, (m, i) -> "
        f"named_struct('start', at[i] + length({pieces}[i]), 'kind', {kind}, 'end', at[i] + length({pieces}[i]) + length(m), 'token', m))")} end"""


def _bind(value: str, name: str, body: str) -> str:
    """SQL for "let name = value in body"."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _tail(z: str) -> str:
    """Upper tail of the normal distribution, by a logistic with a cubic term (absolute error below 2e-4, monotone)."""
    return f"1 / (1 + exp(least(700D, greatest(-700D, 0.07056 * pow({z}, 3) + 1.5976 * ({z})))))"


#: The neighbouring letters of run u, as strings of two, and the place of such a string x in a table of pairs.
_PAIRS = "regexp_extract_all(lower(u), '(?=([a-z][a-z]))', 1)"
_PLACE = f"ascii(x) * 26 + ascii(substring(x, 2, 1)) - {97 * 27}"


def _table(pairs: list[float]) -> str:
    return f"array({', '.join(f'{x!r}D' for x in pairs)})"


def unlike_words(token: str, pairs: list[float]) -> str:
    """SQL for -ln p, in halves and at most ``MOST_HALVES``, of a run's letter pairs under the corpus's."""
    total = f"aggregate(q, 0D, (a, x) -> a + {_table(pairs)}[{_PLACE}])"
    return _bind(token, "u", _bind(_PAIRS, "q", f"cast(least({MOST_HALVES}D, greatest(0D, floor(-2 * {total}))) as int)"))


def _pairs_test(pairs: list[float]) -> str:
    """SQL for the p-value of the letter pairs of run u in base k: ``pairs`` is the log of how much likelier each of 26 x 26 is than by chance."""

    def moments(letters: range) -> tuple[float, float]:
        own = [pairs[a * 26 + b] for a in letters for b in letters]
        mean = sum(own) / len(own)
        return mean, sum((x - mean) ** 2 for x in own) / len(own)

    (m, v), (m16, v16) = moments(range(26)), moments(range(6))
    z = f"(aggregate(q, 0D, (a, x) -> a + {_table(pairs)}[{_PLACE}]) - size(q) * if(k = 16, {m16!r}D, {m!r}D)) / sqrt(size(q) * if(k = 16, {v16!r}D, {v!r}D))"
    return _bind(_PAIRS, "q", f"case when size(q) < 6 or if(k = 16, {v16!r}D, {v!r}D) < 1e-9 then 1D else {_tail(z)} end")


def randomness(token: str, pairs: list[float] | None = None, least: float = 0.0) -> str:
    """SQL for the p-value of a run: small if its characters are not random in the encoding it seems to have; without ``pairs``, three tests.

    Where the letter pairs alone put it below ``least``, the other tests are not made, and some value below ``least`` is given.
    """
    alphabet = "case k when 10 then '0123456789' when 16 then '0123456789abcdef' when 32 then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' else 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' end"
    kind = "case when u rlike '^[0-9]+$' then 10 when u rlike '^[0-9a-f]+$' or u rlike '^[0-9A-F]+$' then 16 when u rlike '^[A-Z2-7]+$' then 32 else 64 end"
    n = "cast(size(v) as double)"
    chi = f"(aggregate(array_distinct(v), 0D, (a, x) -> a + pow(size(filter(v, y -> y = x)), 2)) * k / {n} - {n} - (k - 1)) / sqrt(2D * (k - 1) * ({n} - 1) / {n})"
    turns = f"(1 + size(filter(sequence(1, size(v) - 1), i -> (v[i] * 2 >= k) <> (v[i - 1] * 2 >= k))))"
    high = "cast(size(filter(v, x -> x * 2 >= k)) as double)"
    runs = _bind(high, "h", f"case when h = 0 or h = {n} then 40D else ({turns} - (2 * h * ({n} - h) / {n} + 1)) / sqrt(greatest(1e-9, 2 * h * ({n} - h) * (2 * h * ({n} - h) - {n}) / ({n} * {n} * ({n} - 1)))) end")
    serial = f"aggregate(sequence(1, size(v) - 1), 0D, (a, i) -> a + (v[i] - (k - 1) / 2D) * (v[i - 1] - (k - 1) / 2D)) / sqrt({n} - 1) / ((k * k - 1) / 12D)"
    tests = [_tail(chi), f"2 * {_bind(f'abs({runs})', 'z', _tail('z'))}", f"2 * {_bind(f'abs({serial})', 'z', _tail('z'))}", *(["w"] if pairs else [])]
    p = f"least(1D, {len(tests)} * least({', '.join(tests)}))"
    values = f"transform(filter(split(case k when 16 then lower(u) else u end, ''), c -> c <> ''), c -> instr({alphabet}, c) - 1)"
    p = _bind(values, "v", p)
    if pairs:
        p = _bind(_pairs_test(pairs), "w", f"case when {len(tests)} * w < {least!r}D then {len(tests)} * w else {p} end")
    return _bind(f"translate(rtrim('=', {token}), '-_', '+/')", "u", _bind(kind, "k", p))


#: Frequent letters, whose counts alone tell most ordinary runs from chance.
FREQUENT = "etaoinsrhldcum"


def unlike_chance(token: str, n: str, letters: str, least: float) -> str:
    """SQL that is true only of runs whose chi-squared test alone puts the p-value of the four tests below ``least``.

    ``n`` and ``letters`` name columns of ``told_by``. Of the characters' counts, the squares of ``FREQUENT`` letters are added up and every other
    character counts once: no more than the whole sum, so what is true here is so in the battery; the rest is left to it. No step is
    made for each character. Only runs that are base 64 for sure are told.
    """
    # (c - 1/2) ** 2 - 1/4 is the square of a count less the count: what a letter adds where every character counts once
    more = " + ".join(f"pow({n} - length(replace({letters}, '{x}', '')) - 0.5D, 2)" for x in FREQUENT)
    z = f"(({n} + {more} - {len(FREQUENT) / 4!r}D) * 64 / {n} - {n} - 63) / sqrt(126D * ({n} - 1) / {n})"
    return f"({token} rlike '[g-z+/_-]' and 4 * {_tail(z)} < {least!r}D)"


def told_by(token: str) -> tuple[str, str]:
    """SQL for the two columns of ``unlike_chance``: a run's length without its end marks, and the run, in a-z if it has none of them."""
    bare = f"rtrim('=', {token})"
    return f"length({bare})", f"if({bare} = upper({bare}), lower({bare}), {bare})"


def _step(p: str) -> str:
    return f"cast(least({MOST_STEPS}D, floor(-ln(greatest({p}, 1e-200)) * {STEPS})) as int)"


def _class(token: str) -> str:
    return "case " + " ".join(f"when length({token}) >= {n} then {n}" for n in reversed(CLASSES)) + " end"


#: Runs that the tests are asked about: digits alone as decimal, else what mixes digits with letters, or cases.
_ASKED = "(t rlike '^[0-9]+=*$' or t rlike '[0-9]' and t rlike '[A-Za-z]' or t rlike '[a-z]' and t rlike '[A-Z]')"


#: Words of a name that decoys are cut from, and the class of each of six names in turn: about as many pieces in each class.
NAME_WORDS, NAME_CLASSES = 32, (0, 1, 1, 2, 2, 2)


def _decoys(text: str) -> str:
    """SQL for the decoys of a text: all its words outside runs as names of ``NAME_WORDS``, each in a style and for a class drawn by the
    text's hash and the name's place; a name is cut into pieces of its class's length, the last of which ends where the name does."""
    number = "cast(pmod(g + i, 100) as string)"
    mixed = lambda word: f"transform(w, (x, i) -> if(pmod(g + i, 3) = 0, concat({word}, {number}), {word}))"
    styles = [
        "concat(lower(w[0]), array_join(transform(slice(w, 2, size(w)), x -> initcap(lower(x))), ''))", "array_join(transform(w, x -> initcap(lower(x))), '')",
        f"array_join({mixed('initcap(lower(x))')}, '')", *[f"array_join({mixed(word)}, '{mark}')" for word, mark in (("lower(x)", "-"), ("lower(x)", "_"), ("upper(x)", "_"), ("lower(x)", "/"), ("initcap(lower(x))", "/"))],
    ]
    name = f"case when size(w) < 2 then '' else case pmod(g, {len(styles)}) " + " ".join(f"when {i} then {x}" for i, x in enumerate(styles)) + " end end"
    drawn = f"array({', '.join(str(CLASSES[i]) for i in NAME_CLASSES)})[pmod(g div {len(styles)}, {len(NAME_CLASSES)})]"
    # a name too short for its class goes to the longest class that it reaches
    size = f"case when length(d) >= {drawn} then {drawn} " + " ".join(f"when length(d) >= {n} then {n}" for n in reversed(CLASSES)) + " end"
    pieces = "transform(sequence(0, (length(d) - 1) div n), j -> substring(d, least(cast(j * n as int), length(d) - n) + 1, n))"
    cut = _bind(name, "d", _bind(size, "n", f"case when n is null then cast(array() as array<string>) else filter({pieces}, t -> {_ASKED}) end"))
    names = f"transform(sequence(0, (size(a) - 1) div {NAME_WORDS}), j -> slice(a, cast(j * {NAME_WORDS} + 1 as int), {NAME_WORDS}))"
    words = f"regexp_extract_all(regexp_replace({text}, {_sql(RUN)}, ' '), '[A-Za-z]{{2,}}', 0)"
    each = f"flatten(transform({names}, (w, j) -> {_bind('pmod(h + j * 7919, 1000003)', 'g', cut)}))"
    return _bind(words, "a", f"case when size(a) < 2 then cast(array() as array<string>) else {_bind(f'pmod(xxhash64({text}, 1), 1000003)', 'h', each)} end")


def letter_pairs(docs: DataFrame, floor: float = 0.5) -> list[float]:
    """For each pair of letters a, b (place 26 * a + b) the log of how much likelier b follows a than 1 in 26, in all rows of ``docs``.

    All neighbouring letters of the whole texts count, A-Z as a-z, but for those in runs. Stretches of a run's characters that are too short for one
    are counted first, each with its number, so that a frequent word is cut into pairs once; 676 sums reach the driver.
    """
    parts = docs.select(F.explode(F.expr("regexp_extract_all(text, '[A-Za-z0-9+/_-]{2,}', 0)")).alias("part")).where(f"length(part) < {CLASSES[0]} and part rlike '[A-Za-z]{{2}}'")
    parts = parts.groupBy(F.lower("part").alias("u")).agg(F.count("*").alias("n"))
    pairs = parts.select(F.explode(F.expr(_PAIRS)).alias("pair"), "n")
    seen = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [math.log(26 * (seen.get(a + b, 0) + floor) / (sum(seen.get(a + c, 0) for c in letters) + 26 * floor)) for a in letters for b in letters]


def thresholds(docs: DataFrame, pairs: list[float], rate: float = 0.05, level: float = 0.01) -> dict[int, tuple[int, int]]:
    """For each length class where a run is reported: the largest step of -ln p of the battery, and the least ``unlike_words``.

    One of the two must hold, and in either case no run is reported that the battery calls not random at ``level``, however ordinary text fares.
    Runs and decoys are counted by class and step, a table of at most ``2 * len(CLASSES) * (MOST_STEPS + 1) * (MOST_HALVES + 1)`` rows; one row a
    class reaches the driver. Where nothing can be reported in one way, its bound is out of reach.
    """
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    runs = F.expr(f"transform(filter(regexp_extract_all(text, {_sql(RUN)}, 0), t -> {_ASKED}), t -> named_struct('t', t, 'run', 1))")
    both = text.select(F.explode(F.concat(runs, F.expr(f"transform({_decoys('text')}, t -> named_struct('t', t, 'run', 0))"))).alias("x")).select("x.t", "x.run")
    # what a p-value below half the level is does not matter: no bound lies there
    n, letters = told_by("t")
    step = f"if({unlike_chance('t', 'n', 'letters', level / 2)}, {MOST_STEPS}, {_step(randomness('t', pairs, level / 2))})"
    both = both.selectExpr("t", "run", f"{n} as n", f"{letters} as letters").selectExpr("t", "run", f"{_class('t')} as class", f"{step} as step")
    counts = both.selectExpr("class", "step", "run", f"if(run = 1 and step <= {-math.log(level) * STEPS}, {unlike_words('t', pairs)}, 0) as halves")
    counts = stage(counts.groupBy("class", "step", "halves").agg(F.sum("run").alias("runs"), F.sum(1 - F.col("run")).alias("decoys")), "run-counts")
    up, all_ = "over (partition by class order by step rows unbounded preceding)", "over (partition by class)"
    sums = counts.groupBy("class", "step").agg(F.sum("runs").alias("runs"), F.sum("decoys").alias("decoys"))
    sums = sums.selectExpr("class", "step", "runs", f"sum(runs) {up} as found", f"sum(runs) {all_} as total", f"sum(decoys) {up} as passed", f"sum(decoys) {all_} as all")
    held = sums.where(f"runs > 0 and step <= {-math.log(level) * STEPS} and (1 + passed) / (1 + all) <= {rate / 2} * found / total").groupBy("class").agg(F.max("step").alias("bound"))
    odd = counts.groupBy("class", "halves").agg(F.sum("runs").alias("runs"))
    odd = odd.selectExpr("class", "halves", f"sum(runs) {up.replace('order by step', 'order by halves desc')} as found", f"sum(runs) {all_} as total")
    least = odd.where(f"halves > 0 and exp(-halves / 2D) <= {rate / 2} * found / total").groupBy("class").agg(F.min("halves").alias("bound"))
    steps, halves = ({r["class"]: r["bound"] for r in x.collect()} for x in (held, least))
    return {n: (steps.get(n, -1), halves.get(n, MOST_HALVES + 1)) for n in CLASSES}


def span_columns(docs: DataFrame, rate: float = 0.05, level: float = 0.01) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, of names not in it: the base spans and all spans, sorted; and their names.

    Returned as (DataFrame, base, spans): arrays of (start, kind, end, token), kind an index of ``KINDS``.
    """
    pairs = letter_pairs(docs)
    limits = thresholds(docs, pairs, rate, level)
    used = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in used else free(f"_{name}")
    m = {k: free(f"m_{k}") for k in ("text", "assign", "value", "access", "hex", "run", "base", "spans")}
    q = {k: f"`{v}`" for k, v in m.items()}
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumn(m["text"], text)
    df = df.withColumns({m[k]: F.regexp_extract_all(F.col(q["text"]), F.lit(r), F.lit(0)) for k, r in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN))})
    df = df.withColumn(m["value"], F.expr(f"case when size({q['assign']}) = 0 then array() else regexp_extract_all({q['text']}, {_sql(ASSIGN)}, 2) end"))
    # (split only where there is a match; the pieces are what stands between the matches)
    pieces = {k: free(f"p_{k}") for k in ("assign", "access", "hex", "run")}
    df = df.withColumns({pieces[k]: F.expr(f"case when size({q[k]}) = 0 then array() else split({q['text']}, {_sql(r)}, -1) end") for k, r in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN))})
    spans = {k: _found(i, q[k], f"`{pieces[k]}`") for i, k in enumerate(("assign", "access", "hex", "run"))}
    long_enough = f"filter({spans['assign']}, (s, i) -> length({q['value']}[i]) >= 6)"
    empty = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,token:string>>)"
    base = f"array_sort(concat({empty}, {long_enough}, {spans['access']}, {spans['hex']}))"
    df = df.withColumn(m["base"], F.expr(base))
    most, least = ("case " + " ".join(f"when length(s.token) >= {n} then {limits[n][i]}" for n in reversed(CLASSES)) + " end" for i in (0, 1))
    passes = _bind(_step(randomness("s.token", pairs, level / 2)), "g", f"g <= {most} or g <= {-math.log(level) * STEPS} and {unlike_words('s.token', pairs)} >= {least}")
    # base spans are in order of their starts: blocks of them, with the reach of each, are passed over as a whole
    blocks = f"transform(sequence(0, (size({q['base']}) - 1) div b), j -> slice({q['base']}, cast(j * b + 1 as int), b))"
    reach = _bind(f"cast(ceil(sqrt(size({q['base']}))) as int)", "b", f"transform({blocks}, k -> named_struct('lo', k[0].start, 'hi', array_max(transform(k, x -> x.end)), 'k', k))")
    reach = f"case when size({q['base']}) = 0 then cast(array() as array<struct<lo:bigint,hi:bigint,k:array<struct<start:bigint,kind:int,end:bigint,token:string>>>>) else {reach} end"
    met = "exists(r, k -> k.lo < s.end and s.start < k.hi and exists(k.k, x -> x.start < s.end and s.start < x.end))"
    random = f"{_bind(reach, 'r', f"filter({spans['run']}, s -> {_ASKED.replace('t rlike', 's.token rlike')} and not {met} and {passes})")}"
    df = df.withColumn(m["spans"], F.expr(f"array_sort(concat({q['base']}, {random}))"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], m["base"], m["spans"]), m["base"], m["spans"]


def _sql(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def joined(spans: str) -> str:
    """SQL for "kind:start:end" of all spans, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, base and spans, arrays of (start, kind, end, token).

    ``base`` has the matches of the fixed patterns, ``spans`` these and the runs that the battery reports as random and
    that overlap none of them. Start and end are code points, end exclusive; kind is an index of ``KINDS``. A null text is
    empty; texts of any length are read whole, and n matches take n ** 1.5 short steps. Repeated rows and null ids are rows like any other; other columns are not looked at. No rows give none.
    """
    df, base, spans = span_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rate)
    return df.select("doc_id", F.col(base).alias("base"), F.col(spans).alias("spans"))


def redact_secrets(docs: DataFrame, rate: float = 0.05, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark`` and n_chars, if there, renewed; all rows stay.

    Of overlapping spans the first stands for all. Texts without a secret, and null texts, are as they were.
    """
    df, _, spans = span_columns(docs, rate)
    q = f"`{spans}`"
    # what stands before each span, from the end of the spans before it; a span inside an earlier one leaves nothing
    ends = _running(f"transform({q}, x -> x.end)", "0L", _MOST)
    kept = f"transform({q}, (x, i) -> case when x.start >= at[i] then concat(substring(text, cast(at[i] + 1 as int), cast(x.start - at[i] as int)), {_sql(mark)}) else '' end)"
    last = f"substring(text, cast(array_max(transform({q}, x -> x.end)) + 1 as int))"
    cut = _bind(ends, "at", f"concat(array_join({kept}, ''), {last})")
    df = df.withColumn("text", F.expr(f"case when size({q}) = 0 then text else {cut} end"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        df = df.withColumn("n_chars", F.when(F.size(q) == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
