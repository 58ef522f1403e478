"""Personal data: high-recall generators, boosted trees on format and context, calibrated thresholds, redaction.

Everything that touches rows is SQL. Generators propose spans, some of which overlap: the four base patterns, and looser
ones (bracketed e-mail addresses, national phone numbers, colon-separated hexadecimal groups, cards with other separators, long runs
of letters, digits and marks that may be secrets). A candidate carries small integer features of its format and surroundings.

Labels come from evidence that is no feature: a base pattern's own rule (digit counts, octets, Luhn); Luhn for cards with
other separators; a country code before a national number; the number of groups of an address of colons; a key word and a sign of
assignment before a run (token = ...), while runs without a digit, and in web addresses, are none. Candidates without such evidence are not learned from,
but are judged like all others. Labelled candidates of all documents are counted by feature values, of which there are
at most CELLS; a fifth of the texts, by hash, is kept apart. The trees are fitted to the counts on the driver and go back into the plan as
one CASE expression; the fifth sets each kind's threshold, from which on PRECISION of its candidates are positive. A span is selected if
it is a base span, or if its score reaches its kind's threshold and it touches no base span; its label has no say in that.

Null and empty texts have no spans; repeated rows and ties are judged alike, as scores hang on features alone; texts of any length are
whole, and the work grows in proportion to a text's length and matches: offsets are sums over blocks of matches, and arrays are bound once
for a row; extra columns may have any name; an empty table gives no rows, and a table without labelled candidates adds no spans of
their kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, common

KINDS = ("email", "ip", "card", "phone", "secret")
FEATURES = {"kind": 5, "digits": 5, "marks": 5, "mix": 5, "size": 7, "left": 3, "right": 3, "word": 2, "even": 2}
#: A bound on the distinct feature values: the product of the sizes above.
CELLS = 5 * 5 * 5 * 5 * 7 * 3 * 3 * 2 * 2
PRECISION = 0.995

_LOCAL = "[A-Za-z0-9._%+-]"
#: A match can start where a run of local-part characters starts or where the match before it ended.
_AT_RUN = f"(?:(?<!{_LOCAL})|\\G)"
#: (generator, kind, base, text that every match holds, pattern). Possessive forms of the base patterns: they match the
#: same spans without backtracking.
GENERATORS = (
    ("email", 0, True, ("@",), f"{_AT_RUN}{_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"),
    ("ip", 1, True, (".",), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", 2, True, (), r"(?=[0-9](?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+"),
    ("phone", 3, True, ("+",), r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email_bracketed", 0, False, ("at]", "at)", "at}"), f"{_AT_RUN}{_LOCAL}++\\x20?[\\[({{]at[\\])}}]\\x20?[A-Za-z0-9-]++(?:\\x20?(?:[\\[({{]dot[\\])}}]|\\.)\\x20?[A-Za-z0-9-]++)++"),
    ("ip_six", 1, False, (":",), r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("card_marked", 2, False, (), r"(?<![0-9A-Za-z./_])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{2,7}(?![0-9A-Za-z])"),
    ("phone_national", 3, False, (), r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    ("secret_run", 4, False, (), r"(?<![0-9A-Za-z+/_=.-])[0-9A-Za-z+/_-]{20,}+={0,2}(?![0-9A-Za-z+/_=-])"),
)
#: What labels a candidate without a base rule, by the text before it: {generator: (positive, negative)}.
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)[\x22']?\s*[:=]?\s*[\x22']?$"
WEB = r"(?i)(?:https?:|www\.)\S*$"
COUNTRY = r"\+[0-9]{1,3}[\x20.-]?$"
#: Words near a span that tell of personal data.
CONTEXT = r"(?i)(?:mail|write to|contact|phone|tel|call|mobile|fax|card|visa|pay|account|ip|address|host|server|user|login)"

#: label: 1 or 0 by the evidence, -1 without any. sure: whether label is a base pattern's.
CANDIDATE = "struct<start:int,kind:int,stop:int,base:boolean,label:int,digits:int,marks:int,mix:int,size:int,left:int,right:int,word:int,even:int>"
#: Items of one block of a running sum or maximum over an array.
BLOCK = 64


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn(digits: str) -> str:
    """SQL: whether the digits of a string expression pass the Luhn check."""
    at = f"CAST(substring({digits}, length({digits}) + 1 - i, 1) AS INT)"
    doubled = f"CASE WHEN i % 2 = 0 THEN {at} * 2 - CASE WHEN {at} > 4 THEN 9 ELSE 0 END ELSE {at} END"
    return f"(length({digits}) > 0 AND aggregate(sequence(1, greatest(1, length({digits}))), 0, (s, i) -> s + {doubled}) % 10 = 0)"


def octets(match: str) -> str:
    """SQL: whether the dotted parts of a string expression are numbers up to 255."""
    part = "trim(LEADING '0' FROM p)"
    return f"(size(split({match}, '[.]', -1)) = 4 AND forall(split({match}, '[.]', -1), p -> p rlike '^[0-9]+$' AND length({part}) <= 3 AND coalesce(try_cast(concat('0', {part}) AS INT), 999) <= 255))"


def _label(name: str, kind: int, base: bool, ok: str) -> str:
    """SQL: the label of a candidate."""
    if base:
        return f"CASE WHEN {ok} THEN 1 ELSE 0 END"
    return {
        "email_bracketed": "-1",
        "ip_six": "CASE WHEN size(split(x.m, ':', -1)) = 8 THEN 1 ELSE 0 END",
        "card_marked": f"CASE WHEN {luhn('x.d')} THEN 1 ELSE 0 END",
        "phone_national": f"CASE WHEN x.before rlike {_quoted(COUNTRY)} THEN 1 ELSE -1 END",
        "secret_run": f"CASE WHEN x.before rlike {_quoted(WEB)} OR x.d = '' THEN 0 WHEN x.before rlike {_quoted(ASSIGNED)} THEN 1 ELSE -1 END",
    }[name]


def _candidate(name: str, kind: int, base: bool) -> str:
    """SQL: the candidate of a match m that starts at `start`, between the texts `before` and `after`."""
    m, digits = "x.m", "x.d"
    ok = {0: "true", 1: octets(m), 2: f"(length({digits}) BETWEEN 14 AND 19 AND {luhn(digits)})", 3: f"(length({digits}) BETWEEN 10 AND 15)"}.get(kind, "false")
    edge = lambda c: f"CASE WHEN {c} = '' THEN 0 WHEN {c} rlike '[A-Za-z0-9]' THEN 2 ELSE 1 END"
    share = f"length({digits}) * 8 DIV length({m})"  # eighths of the match that are digits; a phone's and card's rule counts them
    features = [
        f"CASE WHEN {kind} IN (2, 3) THEN 0 ELSE CASE WHEN length({digits}) = 0 THEN 0 WHEN {share} < 2 THEN 1 WHEN {share} < 4 THEN 2 WHEN {share} < 7 THEN 3 ELSE 4 END END",
        f"least(4, length(regexp_replace({m}, '[A-Za-z0-9]', '')))",
        f"CASE WHEN {m} rlike '^[^A-Za-z]*$' THEN 0 WHEN NOT {m} rlike '[g-zG-Z]' THEN 1 WHEN NOT {m} rlike '[A-Z]' THEN 2 WHEN NOT {m} rlike '[a-z]' THEN 3 ELSE 4 END",
        f"CASE WHEN length({m}) < 10 THEN 0 WHEN length({m}) < 15 THEN 1 WHEN length({m}) < 20 THEN 2 WHEN length({m}) < 28 THEN 3 WHEN length({m}) < 44 THEN 4 WHEN length({m}) < 80 THEN 5 ELSE 6 END",
        edge("right(x.before, 1)"),
        edge("x.after"),
        "0" if kind == 4 else f"CASE WHEN x.before rlike {_quoted(CONTEXT)} THEN 1 ELSE 0 END",
        f"CASE WHEN {m} rlike '^[0-9]{{4}}(?:[^0-9][0-9]{{4}})+$' OR {digits} = {m} THEN 1 ELSE 0 END",
    ]
    is_base = ok if base else "false"
    values = ["x.start", str(kind), f"x.start + length({m})", is_base, _label(name, kind, base, ok), *features]
    return f"CAST(struct({', '.join(values)}) AS {CANDIDATE})"


def _bound(values: dict[str, str], body: str, v: str) -> str:
    """SQL: body, which names the values as fields of v. They are worked out once for a row, wherever lambdas in body use them; as
    plain columns the optimizer would move them into the lambdas, which work them out for each item."""
    return f"transform(array(struct({', '.join(f'{x} AS {n}' for n, x in values.items())})), {v} -> {body})[0]"


def _plus(a: str, b: str) -> str:
    return f"({a} + {b})"


def _most(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _part(items: str, fold, first: str, n: str) -> str:
    """SQL: the fold of n numbers of an array from a place (from 0) on."""
    return f"aggregate(slice({items}, {first} + 1, {n}), 0, (x, y) -> {fold('x', 'y')})"


def _blocks(items: str) -> str:
    """SQL: the numbers from 0 of the blocks of an array that is not empty."""
    return f"sequence(0, (size({items}) - 1) DIV {BLOCK})"


def _running(items: str, fold, body: str) -> str:
    """SQL: body, in which _before(i, fold) folds the numbers of the array before place i. Sums of blocks, and of blocks of blocks, keep
    that at a few steps a number."""
    whole = lambda a: f"transform({_blocks(a)}, j -> {_part(a, fold, f'j * {BLOCK}', str(BLOCK))})"
    upto = fold(_part("l2.wide", fold, "0", f"j DIV {BLOCK}"), _part("l2.sums", fold, f"j DIV {BLOCK} * {BLOCK}", f"j % {BLOCK}"))
    ready = _bound({"items": "l2.items", "before": f"transform(l2.sums, (unused, j) -> {upto})"}, body, "l3")
    wide = _bound({"items": "l1.items", "sums": "l1.sums", "wide": whole("l1.sums")}, ready, "l2")
    return _bound({"items": items}, _bound({"items": "l0.items", "sums": whole("l0.items")}, wide, "l1"), "l0")


def _before(i: str, fold) -> str:
    return fold(f"l3.before[{i} DIV {BLOCK}]", _part("l3.items", fold, f"{i} DIV {BLOCK} * {BLOCK}", f"{i} % {BLOCK}"))


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """`row`, a struct of the columns `keep` of docs, `held_back`, whether its labels set thresholds, and `candidates`, its
    spans with their features. Null text: none."""
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("held_back", F.expr("pmod(xxhash64(__text), 5) = 0"))
    steps: list[list[Column]] = [[], []]
    none = "CAST(array() AS array<{}>)"
    for name, kind, base, needs, pattern in GENERATORS:
        found = f"regexp_extract_all(__text, {_quoted(pattern)}, 0)"
        if needs:
            held = " OR ".join(f"contains(__text, {_quoted(n)})" for n in needs)
            found = f"CASE WHEN {held} THEN {found} ELSE {none.format('string')} END"
        steps[0].append(F.expr(found).alias(f"m_{name}"))
        # a match starts after all gaps and matches before it and its own gap
        start = f"{_before('i', _plus)} + length(t.g[i])"
        items = f"transform(t.m, (m, i) -> struct({start} AS start, m AS m, regexp_replace(m, '[^0-9]', '') AS d, right(t.g[i], 40) AS before, left(t.g[i + 1], 1) AS after))"
        judged = f"transform({items}, x -> {_candidate(name, kind, base)})"
        placed = _running("transform(t.m, (m, i) -> length(m) + length(t.g[i]))", _plus, judged)
        whole = _bound({"m": f"m_{name}", "g": f"split(__text, {_quoted(pattern)}, -1)"}, placed, "t")
        steps[1].append(F.expr(f"CASE WHEN size(m_{name}) = 0 THEN {none.format(CANDIDATE)} ELSE {whole} END").alias(f"c_{name}"))
    for step in steps:
        rows = rows.select("*", *step)
    return rows.select("row", "held_back", F.concat(*[F.col(f"c_{g[0]}") for g in GENERATORS]).alias("candidates"))


def fit(found: DataFrame) -> tuple[boosting.Boosted, list[float]]:
    """Trees and each kind's threshold, from the labelled candidates of all rows; a kind without any in the texts held back takes
    those of all texts."""
    names = list(FEATURES)
    counted = found.select("held_back", F.explode("candidates").alias("c")).filter("c.label >= 0").groupBy(*[F.col(f"c.{f}").alias(f) for f in names])
    numbers = [F.count_if(F.expr(f"c.label = {label} AND {'' if back else 'NOT '}held_back")) for back in (False, True) for label in (1, 0)]
    rows = counted.agg(*[n.alias(f"__{i}") for i, n in enumerate(numbers)]).collect()  # at most CELLS
    cells = sorted((({f: r[f] for f in names}, *(r[f"__{i}"] for i in range(4))) for r in rows), key=lambda c: tuple(c[0].values()))
    model = boosting.fit([(x, p, n) for x, p, n, _, _ in cells if p + n], names)
    limits = []
    for k in range(len(KINDS)):
        own = [c for c in cells if c[0]["kind"] == k]
        back = [(x, p, n) for x, _, _, p, n in own if p + n]
        limits.append(boosting.threshold(model, back or [(x, p, n) for x, p, n, _, _ in own], PRECISION))
    return model, limits


def _distinct(items: str) -> str:
    """SQL: an array ordered and each item once. Structs are compared with their neighbours, as array_distinct compares all pairs."""
    return _bound({"s": f"sort_array({items})"}, "filter(d.s, (x, i) -> i = 0 OR x <> d.s[i - 1])", "d")


def selected(found: DataFrame, model: boosting.Boosted, limits: list[float]) -> DataFrame:
    """found with `base` and `spans`: distinct (start, kind, stop), ordered."""
    limit = "CASE c.kind " + " ".join(f"WHEN {k} THEN {v:.9f}D" for k, v in enumerate(limits)) + " END"
    plain = "transform({}, c -> struct(c.start AS start, c.kind AS kind, c.stop AS stop))"
    out = found.withColumn("base", F.expr(_distinct(plain.format("filter(candidates, c -> c.base)"))))
    # a candidate looks into those blocks of base spans alone that reach to it
    edge = "transform({}, j -> {})".format(_blocks("base"), "struct(base[j * {0}].start AS low, aggregate(slice(base, j * {0} + 1, {0}), 0, (x, b) -> greatest(x, b.stop)) AS high, slice(base, j * {0} + 1, {0}) AS spans)".format(BLOCK))
    touched = "exists(e.blocks, k -> k.low < c.stop AND c.start < k.high AND exists(k.spans, b -> b.start < c.stop AND c.start < b.stop))"
    judged = f"filter(candidates, c -> NOT c.base AND {model.sql('c')} >= {limit})"
    free = _bound({"blocks": f"CASE WHEN size(base) > 0 THEN {edge} END", "judged": judged}, f"filter(e.judged, c -> NOT coalesce({touched}, false))", "e")
    out = out.withColumn("added", F.expr(plain.format(free)))
    return out.withColumn("spans", F.expr(_distinct("concat(base, added)"))).drop("added", "candidates")


def rendered(spans: str) -> Column:
    names = "CASE s.kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}, ':', s.start, ':', s.stop)), ',')")


def detect(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """`row`, a struct of the columns `keep` of docs, with `base` and `spans`: arrays of (start, kind, stop) in code points,
    stop exclusive, ordered. Null and empty texts have none; repeated rows stay repeated."""
    found = common.written(candidates(docs, keep, text_col), "pii-candidates")
    return selected(found, *fit(found))


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first. Characters are taken
    from 32-bit code units, whose places need no search."""
    names = "CASE s.kind " + " ".join(f"WHEN {k} THEN '[{n.upper()}]'" for k, n in enumerate(KINDS)) + " END"
    cut = lambda a, n: f"decode(substring(t.wide, 4 * ({a}) + 1, 4 * ({n})), 'UTF-32')"
    placed = f"transform(t.spans, (s, i) -> struct(s.start AS start, s.kind AS kind, {_before('i', _most)} AS upto))"
    pieces = f"transform(filter({placed}, s -> s.start >= s.upto), s -> concat({cut('s.upto', 's.start - s.upto')}, {names}))"
    whole = f"concat(array_join({pieces}, ''), {cut('t.end', 't.size - t.end')})"
    values = {"spans": spans, "wide": f"encode({text}, 'UTF-32')", "size": f"length({text})", "end": f"aggregate({spans}, 0, (x, y) -> greatest(x, y.stop))"}
    return F.expr(f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {_bound(values, _running('transform(t.spans, s -> s.stop)', _most, whole), 't')} END")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detect() of all documents, with the numbers of base spans by kind, of all spans, and of those that the method adds."""
    found = detect(common.table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{n}") for k, n in enumerate(KINDS[:4])]
    more = [F.size("spans").cast("long").alias("n_spans"), F.expr("CAST(size(filter(spans, s -> s.kind = 4)) AS BIGINT)").alias("n_secret")]
    return found.select("row.doc_id", *counts, *more, F.sha2(rendered("base").cast("binary"), 256).alias("base_sha256"), rendered("spans").alias("spans"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data; n_chars follows the text. Rows without any stay as they are, those of null or empty text among them;
    repeated rows stay repeated; an empty table gives an empty one; further columns are kept."""
    found = detect(docs, docs.columns).withColumn("__new", redacted("row.text"))
    length = F.when(F.size("spans") > 0, F.length("__new").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("__new"), "n_chars": length}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
