"""Personal data: exact base patterns, widened by bootstrapped contexts.

Base: e-mail addresses, IP addresses, card and phone numbers by fixed patterns
and checks; the leftmost non-overlapping matches of each kind, in code points.

Bootstrapping: base matches are seeds, and long hexadecimal strings are seeds of a
fifth kind, secrets.  The words around a seed make lexical patterns (two words
before; one before and one behind; a label before).  Under the same patterns stand
candidates, which look like identifiers but are no base match.  Patterns and
instances (normalised values) form a graph that Spark scores in rounds: a pattern is
as good as the share of its distinct instances that are known to be of one kind, a
candidate as the doubt that all patterns around it leave.  Candidates whose score
reaches ``CONFIDENCE`` become seeds of the next round, in all contexts they have, so
that patterns without a single base match are induced from what was found.  Rounds
end when none is new.  Mentions of the candidates that were found join the result
where they stand under a pattern of at least ``DOUBTFUL``; so do seeds of secrets.
Base spans stay.

Regular expressions are possessive and start only where a match can start, so
that no text, however long, makes them recurse or run in squared time.  Texts are
read once; what is found goes to the shared folder, and joins see mentions only.
Graph sides are aggregated before they are joined.  All of it is DataFrame code.

Defined results: a null text is empty; texts of any length are read whole; equal
values count once as instances, however often copied; a null doc_id is kept; rows
are returned once each, repeated ones too; other columns, whatever their names, are
ignored; an empty table gives an empty result.  Counts are of base matches.  Added
spans overlap neither base spans nor each other; of kinds with equal scores the
last by name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import bounded, table, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: the base ones and what bootstrapping alone finds.
ALL_KINDS = (*KINDS, "secret")
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Possessive forms of the base patterns with the same matches.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Mentions: base matches and what looks like an identifier.
MENTION = "|".join(
    [
        BASE["email"],
        rf"(?<![{_LOCAL}])[{_LOCAL}]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9][A-Za-z0-9.-]*+",
        BASE["phone"],
        r"(?<![A-Za-z0-9])\(?[0-9](?:[\x20().-]{0,2}+[0-9])++(?![A-Za-z0-9_]|-[A-Za-z0-9])",
        # A long token of letters and digits.
        r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    ]
)
#: What a seed of a secret looks like: hexadecimal digits of 128 bits at least, letters and digits among them.
SECRET = r"(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+"
#: Code points of context that are looked at on each side.
CONTEXT = 48
#: Rounds at most; they end earlier when nothing new is found.
ROUNDS = 8
#: Distinct known instances that a pattern needs, the score at which a candidate becomes known, the least rating of a pattern that counts.
SUPPORT, CONFIDENCE, DOUBTFUL = 5, 0.8, 0.5
ENTRY_BYTES = 256
BLOCK = 256


def _running(lengths: str) -> str:
    """SQL: sums of all earlier lengths; blocks keep it from growing with the square of their number."""
    add = "named_struct('total', acc.total + x, 'out', array_append(acc.out, acc.total))"
    empty = "named_struct('total', 0, 'out', CAST(array() AS array<int>))"
    blocks = f"CASE WHEN size({lengths}) = 0 THEN CAST(array() AS array<int>) ELSE sequence(0, (size({lengths}) - 1) div {BLOCK}) END"
    part = f"slice({lengths}, b * {BLOCK} + 1, {BLOCK})"
    inner = f"transform({blocks}, b -> aggregate({part}, {empty}, (acc, x) -> {add}))"
    bases = f"aggregate(transform(own, o -> o.total), {empty}, (acc, x) -> {add}).out"
    return (
        f"flatten(transform(array({inner}), own -> flatten(zip_with(own, {bases}, (o, base) -> transform(o.out, s -> s + base)))))"
    )


def _escaped(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _matches(kind: str) -> Column:
    """Array of the pattern's matches with the length of the text before each."""
    pattern = _escaped(BASE[kind])
    none = "CAST(array() AS array<struct<value: string, gap: int>>)"
    zipped = f"zip_with(regexp_extract_all(body, '{pattern}', 0), transform(split(body, '{pattern}', -1), g -> length(g)), (v, g) -> named_struct('value', v, 'gap', g))"
    test = f"contains(body, '{NEEDS[kind]}') AND body RLIKE '[0-9@]'" if NEEDS[kind] else "body RLIKE '[0-9][ -]?[0-9]'"
    # The last gap, behind the last match, has no match to stand before.
    return F.expr(f"CASE WHEN {test} THEN filter({zipped}, m -> m.value IS NOT NULL) ELSE {none} END")


def _mentions() -> Column:
    """Array of mentions with length and edges of the gaps before and behind them."""
    pattern = _escaped(MENTION)
    none = "CAST(array() AS array<struct<value: string, gap: int, before: string, behind: string>>)"
    gaps = f"transform(split(body, '{pattern}', -1), g -> named_struct('n', length(g), 'tail', right(g, {CONTEXT}), 'head', left(g, {CONTEXT})))"
    zipped = (
        f"transform(array({gaps}), gs -> zip_with(regexp_extract_all(body, '{pattern}', 0), zip_with(gs, slice(gs, 2, size(gs)), (a, b) -> "
        "named_struct('n', a.n, 'tail', a.tail, 'head', b.head)), (v, g) -> named_struct('value', v, 'gap', g.n, 'before', g.tail, 'behind', g.head)))[0]"
    )
    return F.expr(f"CASE WHEN body RLIKE '[0-9@]' OR body RLIKE '[(\\\\[](at|AT)[)\\\\]]' THEN filter({zipped}, m -> m.value IS NOT NULL) ELSE {none} END")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: seq, doc_id, the matches of each kind and the mentions; texts are read here only."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    columns = [_matches(kind).alias(kind) for kind in KINDS]
    found = rows.select("doc_id", *columns, _mentions().alias("mentions"))
    return written(found.select(F.monotonically_increasing_id().alias("seq"), "*"), "matches")


_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (acc, k) -> acc + (CASE WHEN (length({d}) - k) % 2 = 0 THEN CAST(substring({d}, k, 1) AS int) "
    "WHEN CAST(substring({d}, k, 1) AS int) > 4 THEN 2 * CAST(substring({d}, k, 1) AS int) - 9 ELSE 2 * CAST(substring({d}, k, 1) AS int) END)) % 10 = 0"
)


def _valid(kind: str, value: str) -> str:
    """SQL condition that a match passes the kind's check."""
    digits = _DIGITS.format(v=value)
    return {
        "email": "true",
        "ip": f"forall(split({value}, '\\\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {_LUHN.format(d=digits)} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }[kind]


def _spans(kind: str) -> Column:
    """Valid base matches of a kind as (kind, start, end)."""
    starts = _running(f"transform({kind}, m -> m.gap + length(m.value))")
    placed = f"zip_with({kind}, {starts}, (m, s) -> named_struct('value', m.value, 'start', s + m.gap))"
    ok = f"filter({placed}, m -> {_valid(kind, 'm.value')})"
    return F.expr(f"transform({ok}, m -> named_struct('kind', '{kind}', 'start', m.start, 'end', m.start + length(m.value)))")


def mention_rows(found: DataFrame) -> DataFrame:
    """(seq, start, end, kind, kinds, instance, before, behind): kind of seeds, kinds that a candidate may be."""
    starts = _running("transform(mentions, m -> m.gap + length(m.value))")
    placed = (
        f"zip_with(mentions, {starts}, (m, s) -> named_struct('value', m.value, 'start', s + m.gap, 'end', s + m.gap + length(m.value), "
        "'before', m.before, 'behind', m.behind))"
    )
    rows = found.where("size(mentions) > 0").select("seq", F.explode(F.expr(placed)).alias("m")).select("seq", "m.*")
    digits = _DIGITS.format(v="value")
    whole = {k: f"value RLIKE '^(?:{_escaped(BASE[k])})$' AND {_valid(k, 'value')}" for k in KINDS}
    whole["secret"] = f"value RLIKE '^{_escaped(SECRET)}$'"
    seed = "CASE " + " ".join(f"WHEN {whole[k]} THEN '{k}'" for k in ("email", "ip", "phone", "card", "secret")) + " END"
    mail = "contains(value, '@') OR value RLIKE '[(\\\\[](at|AT)[)\\\\]]'"
    shapes = (
        f"CASE WHEN {mail} THEN array('email') WHEN value RLIKE '[A-Za-z]' THEN array('secret') ELSE filter(array("
        f"CASE WHEN value RLIKE '^[0-9]+(\\\\.[0-9]+){{2,5}}$' THEN 'ip' END, "
        f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN 'card' END, "
        f"CASE WHEN length({digits}) BETWEEN 6 AND 15 THEN 'phone' END), k -> k IS NOT NULL) END"
    )
    return rows.select(
        "seq",
        "start",
        "end",
        F.expr(seed).alias("kind"),
        F.expr(shapes).alias("kinds"),
        F.expr(f"CASE WHEN value RLIKE '[A-Za-z@]' THEN lower(value) ELSE {digits} END").alias("instance"),
        *[F.expr(f"regexp_replace(lower({c}), '[0-9]', '0')").alias(c) for c in ("before", "behind")],
    )


def _patterns() -> Column:
    """Lexical patterns of a mention, from the words on both sides."""
    one = r"regexp_extract(before, '(\\S++)\\s*+$', 1)"
    two = r"regexp_extract(before, '(\\S++\\s++\\S++)\\s*+$', 1)"
    right = r"regexp_extract(behind, '^\\s*+(\\S++)', 1)"
    return F.expr(
        "filter(array("
        f"CASE WHEN {two} != '' THEN concat('2 ', regexp_replace({two}, '\\\\s+', ' ')) END, "
        f"CASE WHEN {one} != '' AND {right} != '' THEN concat('3 ', {one}, ' _ ', {right}) END, "
        f"CASE WHEN {one} RLIKE '[:=#]$' THEN concat('1 ', {one}) END), p -> p IS NOT NULL)"
    )


def _rated(edges: DataFrame, seeded: DataFrame, found: DataFrame | None) -> DataFrame:
    """(pattern, kind, rated) of patterns with enough instances that are known: ``seeded`` ones and those ``found``."""
    known = F.col("seeds")
    if found is not None:
        gain = edges.join(bounded(found, ENTRY_BYTES), ["kind", "instance"]).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("gain"))
        seeded = seeded.join(gain, ["pattern", "kind"], "left")
        known = known + F.coalesce("gain", F.lit(0))
    rated = seeded.select("pattern", "kind", (known / (F.col("total") + 1)).alias("rated"), known.alias("known"))
    return written(rated.where((F.col("known") >= SUPPORT) & (F.col("rated") >= DOUBTFUL)).drop("known"), "rated")


def discover(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(seq, kind, start, end) of the unseen identifiers that the patterns of ``mentions`` lead to."""
    seen = mentions.where("kind IS NOT NULL OR size(kinds) > 0").select("*", F.explode(_patterns()).alias("pattern"))
    seen = written(seen.drop("before", "behind"), "contexts")
    # Each instance once under a pattern, with the kind that it is known by or the kinds that it may be of.
    instances = seen.select("pattern", F.coalesce("kind", F.lit("?")).alias("own"), "instance", F.when(F.col("kind").isNull(), F.col("kinds")).alias("kinds"))
    instances = written(instances.groupBy("pattern", "own", "instance").agg(F.max("kinds").alias("kinds")), "instances")
    totals = instances.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= SUPPORT)
    totals = bounded(written(totals, "totals"), ENTRY_BYTES)
    edges = instances.where("own = '?'").select("pattern", "instance", F.explode("kinds").alias("kind"))
    edges = written(edges.join(totals.select("pattern"), "pattern", "left_semi"), "edges")
    sides = instances.where("own != '?'").select("pattern", F.col("own").alias("kind"), F.lit(1).alias("seeds"))
    sides = sides.unionByName(edges.select("pattern", "kind", F.lit(0).alias("seeds")))
    seeded = written(sides.groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds")).join(totals, "pattern"), "seeded")
    found, count = None, 0
    for _ in range(rounds):
        rated = bounded(_rated(edges, seeded, found), ENTRY_BYTES)
        doubt = F.sum(F.log1p(-F.least("rated", F.lit(0.99))))
        scores = edges.join(rated, ["pattern", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("score"))
        found = written(scores.where(F.col("score") >= CONFIDENCE), "found")
        before, count = count, found.count()
        if count == before:  # what is known only grows
            break
    rated = bounded(_rated(edges, seeded, found), ENTRY_BYTES)
    under = seen.where("kind IS NULL OR kind = 'secret'").select("seq", "start", "end", "instance", "pattern", (F.col("kind") == "secret").alias("secret"), F.explode("kinds").alias("kind"))
    under = under.join(rated, ["pattern", "kind"])
    hits = under.where("secret").select("seq", "start", "end", "kind", F.lit(1.0).alias("score"))
    unseen = under.where("secret IS NULL").join(bounded(found, ENTRY_BYTES), ["kind", "instance"])
    hits = hits.unionByName(unseen.select("seq", "start", "end", "kind", "score"))
    best = F.max_by("kind", F.struct("score", "kind"))
    return hits.groupBy("seq", "start", "end").agg(best.alias("kind")).select("seq", "kind", "start", "end")


def _apart(added: DataFrame, base: DataFrame) -> DataFrame:
    """The ``added`` rows that overlap no span of ``base`` (seq, base).  Mentions never overlap each other."""
    own = base.join(bounded(written(added.select("seq").distinct(), "touched"), ENTRY_BYTES), "seq", "left_semi")
    spans = own.select("seq", F.explode("base").alias("b")).select("seq", F.lit(None).cast("string").alias("kind"), "b.start", "b.end")
    order = W.partitionBy("seq").orderBy("start", F.col("kind").isNotNull())  # a document's spans
    past = F.max(F.when(F.col("kind").isNull(), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.min(F.when(F.col("kind").isNull(), F.col("start"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = added.select("seq", "kind", "start", "end").unionByName(spans).select("*", past.alias("past"), ahead.alias("ahead")).where("kind IS NOT NULL")
    return rows.where((F.coalesce("past", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))).select("seq", "kind", "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every document: arrays of (kind, start, end) by kind, then start."""
    found = scan(docs)
    added = written(discover(mention_rows(found)), "discovered")
    base = found.select("seq", "doc_id", F.concat(*[_spans(k) for k in KINDS]).alias("base"))
    added = _apart(added, base).groupBy("seq").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    added = bounded(written(added, "added"), ENTRY_BYTES)
    ranked = f"transform(concat(base, more), s -> named_struct('rank', array_position(array({', '.join(map(repr, ALL_KINDS))}), s.kind), 'start', s.start, 'span', s))"
    merged = f"CASE WHEN more IS NULL THEN base ELSE transform(array_sort({ranked}), s -> s.span) END"
    return base.join(added, "seq", "left").select("doc_id", "base", F.expr(merged).alias("spans"))


def redact(docs: DataFrame, mask: str = "_") -> DataFrame:
    """(doc_id, text) with every code point of a base match replaced by ``mask``."""
    text = F.coalesce("text", F.lit(""))
    for kind in KINDS:
        pattern, need = BASE[kind], NEEDS[kind]
        found = f"zip_with(split(t, '{_escaped(pattern)}', -1), regexp_extract_all(t, '{_escaped(pattern)}', 0), (g, v) -> concat(g, coalesce(CASE WHEN {_valid(kind, 'v')} THEN repeat('{mask}', length(v)) ELSE v END, '')))"
        docs = docs.select("doc_id", text.alias("t"))
        text = F.expr(f"CASE WHEN contains(t, '{need or ''}') THEN array_join({found}, '') ELSE t END")
    return docs.select("doc_id", text.alias("text"))


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select(
        "doc_id", *counts, added, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") > 0).alias("private")
    )


QUERIES = {"op8_pii": query}
ORACLE_SQL: dict[str, str] = {}
