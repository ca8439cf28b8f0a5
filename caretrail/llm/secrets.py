"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger remembers which pairs of a blob and a
version of a rule were scanned and what was found (a row holds the rules of one run over a blob), so a run scans each
blob once by the rules it has not met, however many paths and versions hold it, and joins findings back to all of them.
Raising one rule scans old blobs by that rule alone. Rules are regular expressions run inside the JVM;
where a match begins follows from the lengths of what ``split`` leaves between the matches.

Defined results: a null text is an empty one; an empty text has no findings; rows that repeat each get their findings; a
null path is a path. Columns besides path and text are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import whole_text


@dataclass(frozen=True)
class Rule:
    """``hint`` is a text that every match contains (lower case), '' for none; ``least`` the shortest secret kept."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str = ""
    version: int = 1


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
RULES = (
    Rule("assign", ASSIGN, 2, 12),
    Rule("access", r"(AKIA[A-Z0-9]{14,})", 1, 18, "AKIA"),  # a run of 18 or more: shorter ones are dropped either way
    Rule("hex", r"([0-9a-f]{16,})", 1, 16),
    Rule("pem", r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)", 1, 1, "-----BEGIN"),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, "gh"),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _split_pattern(pattern: str) -> str:
    return pattern.replace("(", "(?:").replace("(?:?", "(?")


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of a rule's matches in order; the pieces between them give the places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1))
    kept = found if rule.group == 1 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    places = F.arrays_zip(
        F.transform(F.split(text, _split_pattern(rule.pattern), -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("match"), F.transform(kept, F.length).alias("secret"))
    walked = F.aggregate(
        places, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["match"], F.lit(0))).alias("at"),
            F.when(x["secret"] >= rule.least, F.concat(a["spans"], F.array(F.struct(
                (a["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                (a["at"] + x["gap"] + x["match"]).alias("end"))))).otherwise(a["spans"]).alias("spans")))["spans"]
    test = text.rlike(rule.pattern)
    if rule.hint:
        test = F.contains(text, F.lit(rule.hint)) & test
    return F.when(test, walked).otherwise(F.array().cast(SPAN))


def rule_keys(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return [f"{r.kind}@{r.version}" for r in rules]


def _names(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(k) for k in rule_keys(rules)])


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rules, spans of every row (blob, text, todo): what those rules find in each text that are named in ``todo``."""
    none = F.array().cast(SPAN)
    spans = F.concat(*[
        F.when(F.array_contains("todo", key), _spans(F.col("text"), rule, i)).otherwise(none)
        for i, (key, rule) in enumerate(zip(rule_keys(rules), rules, strict=True))])
    return blobs.select("blob", F.col("todo").alias("rules"), F.array_sort(spans).alias("spans"))


def current_spans(known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans of ledger rows, as far as they come from these versions of the rules, in order."""
    key = F.create_map(*[F.lit(x) for r, k in zip(rules, rule_keys(rules), strict=True) for x in (r.kind, k)])
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    valid = F.filter("spans", lambda s: F.coalesce(F.array_contains("rules", key[s["kind"]]), F.lit(False)))
    ranked = F.transform(valid, lambda s: s.withField("rank", rank[s["kind"]]))
    return known.where(F.size("spans") > 0).groupBy("blob").agg(
        F.array_sort(F.flatten(F.collect_list(ranked))).alias("spans"))


def address(versions: DataFrame) -> DataFrame:
    """path, blob, text of every row (path, text)."""
    text = whole_text(F.col("text"))
    return versions.select("path", F.sha2(text, 256).alias("blob"), text.alias("text"))


def unseen(addressed: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, text, todo once for each blob that some of these rules have not scanned; ``todo`` names them."""
    # The path that hands in the text is chosen over narrow rows. Joined by a key made of both, so that the many paths of
    # one blob are spread; rows that repeat then lie together and fall to one without another exchange.
    key = F.concat_ws(":", "blob", F.coalesce("path", F.lit(-1 << 63)).cast("string"))
    first = addressed.groupBy("blob").agg(F.min(F.coalesce("path", F.lit(-1 << 63))).alias("path"))
    if ledger is None:
        picked = addressed.withColumn("key", key).join(first.select(key.alias("key")), "key", "left_semi")
        return picked.dropDuplicates(["key"]).select("blob", "text", _names(rules).alias("todo"))
    done = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))  # a row for each run over a blob
    nothing = F.array().cast("array<string>")
    first = first.join(done, "blob", "left").withColumn(
        "todo", F.array_except(_names(rules), F.coalesce("done", nothing))).where(F.size("todo") > 0)
    return addressed.withColumn("key", key).join(first.select(key.alias("key"), "todo"), "key").dropDuplicates(
        ["key"]).select("blob", "text", "todo")


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                 ) -> tuple[DataFrame, DataFrame]:
    """Findings of every row (path, text), as path, blob, spans; and the rows (blob, rules, spans) to add to the ledger."""
    addressed = address(versions)
    new = scan(unseen(addressed, ledger, rules), rules)
    if ledger is None:
        found = new.where(F.size("spans") > 0).select("blob", "spans")
    else:
        found = current_spans(new.unionByName(ledger), rules)
    paths = versions.select("path", F.sha2(whole_text(F.col("text")), 256).alias("blob"))
    none = F.array().cast(SPAN)
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans")), new


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
