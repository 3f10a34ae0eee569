"""Secret scan with a trigram inverted index. Native operators only.

Every rule's regex is turned into a Boolean query over trigrams that any matching text must hold. The index lists, for each
trigram that some query names, the documents that hold it; postings are intersected by document, and only candidates are
searched with the regex itself. A rule whose regex forces no trigram is searched for in every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize


@dataclass(frozen=True)
class Rule:
    """kind names the spans; group and least: matches whose group is shorter than least characters are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base rules, in the order that breaks ties of equal starts.
BASE = [Rule("assign", ASSIGN, 2, 6), Rule("access", r"AKIA[A-Z0-9]{16,}"), Rule("hex", r"[0-9a-f]{24,}")]
#: Well-known token forms beyond the base rules.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"), Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"), Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"), Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
]


def literals(regex: str, most: int = 64) -> list[list[str]]:
    """A regex as a conjunction of clauses; each clause lists lower-case strings one of which every match contains.

    Follows the parse tree: a run of small character sets is multiplied out into whole strings until there are more than
    `most` of them, a branch joins the strings of its arms, and anything optional or wide ends the run. Clauses with a
    string of fewer than three characters force no trigram and are left out.
    """
    clauses: list[list[str]] = []

    def sets(op, arg) -> list[str] | None:
        if op is sre.LITERAL:
            return [chr(arg).lower()]
        if op is sre.IN and not any(o is sre.NEGATE for o, _ in arg):
            found: set[str] = set()
            for o, a in arg:
                if o is sre.LITERAL:
                    found.add(chr(a).lower())
                elif o is sre.RANGE and a[1] - a[0] < most:
                    found |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
                else:
                    return None
            return sorted(found)
        return None

    def exact(items) -> list[str] | None:
        """All strings of a short sub-expression, if there are few."""
        out = [""]
        for op, arg in items:
            if op is sre.SUBPATTERN:
                more = exact(arg[3])
            elif op is sre.BRANCH:
                arms = [exact(x) for x in arg[1]]
                more = None if None in arms else [x for arm in arms for x in arm]
            elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                more = exact(arg[2])
                more = more and ["", *more]
            elif op is sre.MAX_REPEAT and arg[0] == arg[1]:
                more = exact([*arg[2]] * arg[0])
            else:
                more = sets(op, arg)
            if more is None or len(out) * len(more) > most:
                return None
            out = [a + b for a, b in product(out, more)]
        return out

    def walk(items) -> None:
        run = [""]
        for item in [*items, None]:
            more = None if item is None else exact([item])
            if more and len(run) * len(more) <= most:
                run = [a + b for a, b in product(run, more)]
                continue
            if min(map(len, run)) >= 3:
                clauses.append(sorted(x for x in set(run) if not any(y != x and y in x for y in run)))  # a longer string holds the shorter
            run = more if more else [""]
            if item is not None and not more:
                op, arg = item
                if op is sre.SUBPATTERN:
                    walk(arg[3])
                elif op is sre.MAX_REPEAT and arg[0] > 0:
                    walk(arg[2])

    walk(_parser.parse(regex))
    return clauses


def trigrams(s: str) -> list[str]:
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def grams_of(rules: list[Rule]) -> list[str]:
    return sorted({g for r in rules for clause in literals(r.regex) for s in clause for g in trigrams(s)})


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index (gram: its position in grams, key): one row for each listed trigram that a document holds."""
    low = docs.select("key", ascii_lower(F.col("text")).alias("low"))
    held = F.concat(*[F.when(F.contains("low", F.lit(g)), F.array(F.lit(i))).otherwise(F.array().cast("array<int>")) for i, g in enumerate(grams)])
    return low.select("key", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """key, mask: bit i is set if the document's postings satisfy the query of rule i; documents without a bit do not appear."""
    grams, width = grams_of(rules), 62
    index = postings(docs, grams)
    words = range(-(-len(grams) // width))
    bits = lambda w: F.coalesce(F.bit_or(F.when((F.col("gram") >= w * width) & (F.col("gram") < (w + 1) * width), F.expr(f"shiftleft(1L, gram - {w * width})"))), F.lit(0).cast("long")).alias(f"w{w}")
    met = index.groupBy("key").agg(*[bits(w) for w in words])

    def holds(s: str) -> Column:
        own = [0] * len(words)
        for g in trigrams(s):
            i = grams.index(g)
            own[i // width] |= 1 << i % width
        out = F.lit(True)
        for w, m in enumerate(own):
            if m:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == m)
        return out

    mask = F.lit(0)
    for i, r in enumerate(rules):
        fits = F.lit(True)
        for clause in literals(r.regex):
            some = F.lit(False)
            for s in clause:
                some = some | holds(s)
            fits = fits & some
        mask = mask + F.when(fits, 1 << i).otherwise(0)
    return met.select("key", mask.alias("mask")).where("mask > 0")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind), in code points: what split() leaves between matches gives their places."""
    pattern = F.lit(rule.regex)
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    between, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), checked.alias("part"))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(F.length(x["part"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def find_secrets(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, text (and with carry all input columns as struct row), found: array of (start, order, end, kind) sorted by start, then rule order.

    Candidates are broadcast only if they are counted to be at most broadcast_rows (about 24 bytes each), else joined by
    a shuffle. A null text is empty and has no spans; repeated rows each keep their own row; other columns are ignored.
    """
    rules = BASE + MORE if rules is None else rules
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *row).withColumn("key", F.xxhash64("text"))
    keyed = [r for r in rules if literals(r.regex)]
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    if keyed:
        met = materialize(candidates(docs, keyed))
        met = F.broadcast(met) if met.count() <= broadcast_rows else met
        docs = docs.join(met, "key", "left")
    parts = []
    for order, r in enumerate(rules):
        if r in keyed:
            hit = F.coalesce(F.col("mask").bitwiseAND(F.lit(1 << keyed.index(r))) > 0, F.lit(False))
        else:
            hit = F.col("text").rlike(r.regex)
        parts.append(F.when(hit, spans_of(F.col("text"), r, order)).otherwise(none))
    return docs.select("doc_id", "text", *(["row"] if carry else []), F.array_sort(F.concat(*parts)).alias("found"))


def mask_secrets(df: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """find_secrets() output with every span replaced; overlapping spans give one replacement."""
    def step(acc: Column, x: Column) -> Column:
        begin, kept = F.greatest(acc["at"], x["start"]), acc["out"]
        out = F.when(x["end"] <= acc["at"], kept).otherwise(F.concat(kept, F.substring(F.col("text"), acc["at"] + 1, begin - acc["at"]), F.when((x["start"] >= acc["at"]), F.lit(mask)).otherwise(F.lit(""))))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return df.withColumn("text", F.when(F.size("found") > 0, done).otherwise(F.col("text")))


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of a find_secrets() result; base rules come first in the rule order."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
