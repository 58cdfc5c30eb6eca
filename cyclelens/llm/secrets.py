"""Secret scans through a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression follows a Boolean query on trigrams that every match must satisfy. The index holds, for the trigrams
that rules ask for, the documents that contain them; a rule's postings are intersected within each clause and joined over clauses, and
only the documents that remain are searched with the expression. A rule without mandatory trigrams searches every document.
"""

from __future__ import annotations

import re._constants as rx
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.llm.common import BROADCAST_IDS, named, table, text_or_empty, unused, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java expression, the group that is measured and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order that breaks ties. A match that is too short is dropped, with the characters that it took.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: A private key from its BEGIN line to its END line; where that is missing, to the end of the header and base64 lines behind it. Line breaks
#: may be escaped, as in JSON. Repeats are possessive, which Java runs without a stack.
_BREAK = r"(?:\s|\\[nrt])"
_PEM = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    rf"|(?:{_BREAK}*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{{20,}}+={{0,2}}+))*+"
    rf"(?:[\x20\t]*+(?:[\r\n]|\\[nr]){_BREAK}*+[A-Za-z0-9+/]++={{0,2}}+(?![^\r\n\\\"']))?)"
)
#: Published formats of well-known services.
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", _PEM),
)
#: Strings that a part of an expression may stand for are listed up to this number, then only their ends.
_LISTED = 24
#: Matches of one text whose places are added up together.
_TOGETHER = 512

Query = frozenset[frozenset[str]]  # any of the clauses, each of which needs all its trigrams
ANY: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class _Facts:
    """What holds of every string that a part of an expression matches, all in lower case."""

    exact: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    query: Query


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x, y in product(a, b)))


def _either(a: Query, b: Query) -> Query:
    return _least(a | b)


def _least(q: Query) -> Query:
    """Without the clauses that ask for more than another one does."""
    return frozenset(c for c in q if not any(o < c for o in q))


def _within(strings: frozenset[str]) -> Query:
    return _least(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def _known(strings: frozenset[str]) -> _Facts:
    return _Facts(strings, strings, strings, _within(strings))


_UNKNOWN = _Facts(None, frozenset([""]), frozenset([""]), ANY)


def _then(x: _Facts, y: _Facts) -> _Facts:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= _LISTED:
        return _known(frozenset(a + b for a, b in product(x.exact, y.exact)))
    cross = len(x.ends) * len(y.starts) <= _LISTED * 2
    joint = _within(frozenset(a + b for a, b in product(x.ends, y.starts))) if cross else ANY
    starts, ends = x.starts, y.ends
    if x.exact is not None and len(x.exact) * len(y.starts) <= _LISTED:
        starts = frozenset(a + b for a, b in product(x.exact, y.starts))
    if y.exact is not None and len(x.ends) * len(y.exact) <= _LISTED:
        ends = frozenset(a + b for a, b in product(x.ends, y.exact))
    return _Facts(None, starts, ends, _both(_both(x.query, y.query), joint))


def _or(x: _Facts, y: _Facts) -> _Facts:
    exact = x.exact | y.exact if x.exact is not None and y.exact is not None else None
    return _Facts(exact if exact is None or len(exact) <= _LISTED else None, x.starts | y.starts, x.ends | y.ends, _either(x.query, y.query))


def _facts(nodes) -> _Facts:
    out = _known(frozenset([""]))
    for op, arg in nodes:
        if op is rx.LITERAL:
            part = _known(frozenset([chr(arg).lower()]))
        elif op is rx.IN:
            part = _class(arg)
        elif op is rx.SUBPATTERN:
            part = _facts(arg[3])
        elif op is rx.BRANCH:
            part = reduce(_or, map(_facts, arg[1]))
        elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT):
            least, most, inner = arg
            once = _facts(inner)
            part = _known(frozenset([""]))
            for _ in range(min(least, 3)):
                part = _then(part, once)
            if least > 3 or most != least:
                more = _or(once, _known(frozenset([""]))) if most == least + 1 and least <= 3 else _UNKNOWN
                part = _then(part, more)
        else:
            part = _UNKNOWN
        out = _then(out, part)
    return out


def _class(items) -> _Facts:
    found: set[str] = set()
    for op, arg in items:
        if op is rx.LITERAL:
            found.add(chr(arg).lower())
        elif op is rx.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return _UNKNOWN
    return _known(frozenset(found)) if len(found) <= 8 else _UNKNOWN


def trigram_query(pattern: str) -> Query:
    """The clauses of which the lower-cased text of any match satisfies one; the empty clause asks for nothing."""
    return _least(_facts(parser.parse(pattern)).query)


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(of_id, of_hash, rules): which indexed rules may match the texts with this id and hash. `texts` has doc_id, text_hash, text."""
    clauses = [(r.kind, n, clause) for r in rules for n, clause in enumerate(sorted(trigram_query(r.pattern), key=sorted)) if clause]
    wanted = sorted({t for _, _, clause in clauses for t in clause})
    lowered = texts.select("doc_id", "text_hash", F.lower("text").alias("lowered"))
    present = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in wanted]))
    postings = written(lowered.select("doc_id", "text_hash", F.explode(present).alias("trigram")), "secret-postings")
    # The clauses are as many as the rules ask for, so their table goes to every task; a bit for each trigram makes repeated rows harmless.
    asked = [(kind, n, t, 1 << k, (1 << len(clause)) - 1) for kind, n, clause in clauses for k, t in enumerate(sorted(clause))]
    asked = texts.sparkSession.createDataFrame(asked, "kind string, clause int, trigram string, bit long, all_bits long")
    met = postings.join(F.broadcast(asked), "trigram").groupBy("doc_id", "text_hash", "kind", "clause", "all_bits").agg(F.bit_or("bit").alias("bits"))
    met = met.where("bits = all_bits").groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("rules"))
    return written(met.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "rules"), "secret-candidates")


def _in_blocks(rows: Column) -> Column:
    """An array as an array of arrays of TOGETHER items, the last one shorter. Blocks keep appending to an array in a fold cheap."""

    def cut(held):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(held) - 1) / _TOGETHER).cast("int"))), lambda k: F.slice(held, k * _TOGETHER + 1, F.lit(_TOGETHER)))

    # As the one item of an array, the rows have a name: they are computed once and not again for each block.
    return F.flatten(F.transform(F.array(rows), cut))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Places of the rule's matches: an array of (start, order, end) in code points, the end exclusive.

    The text is split at the matches; lengths of what lies between and of the matches add up to their places, TOGETHER matches at a time.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    empty = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    rows = F.zip_with(
        F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)),
        F.arrays_zip(F.transform(whole, lambda m: F.length(m).cast("long")).alias("n"), F.transform(measured, lambda m: F.length(m)).alias("measure")),
        lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), m["n"].alias("n"), m["measure"].alias("measure")),
    )

    def step(acc, m):
        start = acc["at"] + m["gap"]
        return F.struct((start + m["n"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), m["measure"].alias("kind"), (start + m["n"]).alias("end")))).alias("spans"))

    def block(part):
        return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step)

    blocks = F.transform(_in_blocks(rows), block)

    def lay(acc, b):
        moved = F.transform(b["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["parts"], moved).alias("parts"))

    laid = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:long,kind:int,end:long>>>").alias("parts")), lay)
    # Until here `kind` holds the length that is measured.
    found = F.transform(
        F.filter(F.flatten(laid["parts"]), lambda s: s["kind"] >= rule.least),
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end")),
    )
    return F.when(text.rlike(rule.pattern), found).otherwise(empty)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str, str]:
    """`docs`, all columns, with two more, whose names are returned: the text or an empty one, and the spans of all rules as
    (start, kind, end), ordered, kind being the rule's number.

    Matches of a rule are its leftmost non-overlapping ones; spans of different rules may overlap. A null text is an empty one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))
    # Rows are found again by id and text hash. A hash that two texts share makes a candidate too many at worst.
    may = candidates(texts, rules)
    may = F.broadcast(may) if may.count() <= BROADCAST_IDS // 10 else may
    text, spans_of, may_id, may_hash, may_rules = (unused(docs, n) for n in ("__text", "__spans", "__of_id", "__of_hash", "__rules"))
    may = may.toDF(may_id, may_hash, may_rules)
    own_id, own_hash = F.col(id_col).cast("long"), F.xxhash64(text_or_empty(text_col))
    joined = docs.join(may, own_id.eqNullSafe(F.col(may_id)) & (own_hash == F.col(may_hash)), "left").withColumn(text, text_or_empty(text_col))
    found, none = [], F.array().cast("array<struct<start:long,kind:int,end:long>>")
    for k, rule in enumerate(rules):
        spans = _spans(F.col(text), rule, k)
        found.append(spans if frozenset() in trigram_query(rule.pattern) else F.when(F.array_contains(may_rules, rule.kind), spans).otherwise(none))
    return joined.select(*[named(c) for c in docs.columns], text, F.array_sort(F.concat(*found)).alias(spans_of)), text, spans_of


def _spelled(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, the end exclusive, by start and then by the order of the rules, joined by commas; base_sha256
    is of those of the base rules alone. A null or empty text has none. Rows that repeat, or have a null id, get a row each. An empty
    table gives no rows; other columns are not read.
    """
    rows, _, spans = scanned(docs.select(id_col, text_col), id_col, text_col, rules)
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(spans).alias("__spans"))
    base = F.filter("__spans", lambda s: s["kind"] < len(BASE))
    number = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *[number(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(_spelled(base, rules), 256).alias("base_sha256"), _spelled(F.col("__spans"), rules).alias("spans")
    )


#: What stands for a secret in a redacted text.
MASK = "[REDACTED]"


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with each run of secret characters of the text replaced by MASK; other columns, and texts without secrets, as they are.

    The time is linear in the text and its secrets: a text with secrets is held in four bytes a character, of which the pieces
    between the secrets are cut without counting from the start. Null and empty texts stay as they are, repeated rows get a row each.
    """
    rows, whole, spans = scanned(docs, id_col, text_col, rules)
    gap_type = "array<struct<start:long,end:long>>"
    last = F.length(whole).cast("long")

    def step(acc, s):
        gap = F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end")))
        opened = F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), opened.alias("gaps"))

    def lay(acc, part):
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(gap_type).alias("gaps")), step, lambda end: F.struct(end["at"].alias("at"), F.array(end["gaps"]).alias("parts")))
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["parts"], d["parts"]).alias("parts")))[0]

    begun = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{gap_type}>").alias("parts"))
    gaps = F.aggregate(_in_blocks(F.col(spans)), begun, lay, lambda acc: F.concat(F.flatten(acc["parts"]), F.array(F.struct(acc["at"].alias("start"), last.alias("end")))))
    # A mark of byte order goes before each piece, as a decoder takes a leading one for its own.
    mark = F.unhex(F.lit("0000FEFF"))

    def pieces(wide):
        return F.transform(gaps, lambda g: F.decode(F.concat(mark, F.substring(wide, (g["start"] * 4 + 1).cast("int"), ((g["end"] - g["start"]) * 4).cast("int"))), "UTF-32"))

    masked = F.array_join(F.flatten(F.transform(F.array(F.encode(whole, "UTF-32")), pieces)), MASK)
    text = F.when(F.size(spans) > 0, masked).otherwise(F.col(text_col))
    return rows.select(*[text.alias(c) if c == text_col else named(c) for c in docs.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
