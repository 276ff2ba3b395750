"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host and path together, with the literal tokens that any URL it fits
must hold. Each rule is filed under the one of its tokens that is rarest over all URLs of the table; a URL
fetches the rules filed under its own tokens, and only those expressions run, each compiled when it is first
fetched. Rules without a literal token are fetched by every URL. One pass without a shuffle judges the rows; the
index is a broadcast of the rule list, which is a parameter; ``rules_from`` reads one from a table, with its digest.

Of the base rules that fit, the strongest wins, and among equally strong ones the first of the list; without a
base rule, any fitting rule that blocks does. Null URLs, and those without ``://``, have empty host and path and
are judged as such. URLs are judged whole, however long. Repeated rows are judged each. An empty table stays
empty. Columns but id and URL are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, beside, schema_with

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """name: host and path of a base rule, or the method's own name. strength: the strongest rule wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    base: bool
    strength: int = field(default=0)


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains, where the path starts with path (itself starting with '/')."""
    inner = [m[0] for m in TOKEN.finditer(path.lower()) if m.end() < len(path)]  # the last may go on in the URL
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, verdict, pattern, (*TOKEN.findall(host), *inner), True, len(host + path))


# The rules that must hold.
BASE_RULES = [
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
]
# Words that, as a whole token of the host, mark a site of spam, gambling or pornography.
SPAM_WORDS = "casino poker betting jackpot pills viagra pharmacy porn xxx escort payday lottery".split()


def word_rule(verdict: str, word: str) -> Rule:
    """Fits a host that holds the word between other characters than letters and digits."""
    return Rule(f"host-{word}", verdict, rf"(?:[^/]*[^a-z0-9/])?{re.escape(word)}(?:[^a-z0-9/][^/]*)?(?:/.*)?\Z", (word,), False)


def path_word_rule(verdict: str, words: str) -> Rule:
    """Fits a path that holds these words, in whatever case, between other characters than letters and digits."""
    tokens = tuple(TOKEN.findall(words.lower()))
    inner = "[^A-Za-z0-9]+".join(f"(?i:{t})" for t in tokens)
    return Rule(f"path-{words}", verdict, rf"[^/]*/(?:.*[^A-Za-z0-9])?{inner}(?:[^A-Za-z0-9].*)?\Z", tokens, False)


def site_rule(verdict: str, text: str) -> Rule:
    """A rule of the method, not a base one: a host and its subdomains, and what its paths start with."""
    host, _, path = text.partition("/")
    made = host_rule(verdict, host.lower(), f"/{path}") if path else Rule("", verdict, rf"(?:[^/]*\.)?{re.escape(host.lower())}(?:/.*)?\Z", tuple(TOKEN.findall(host.lower())), False)
    return replace(made, name=f"site-{text}", base=False, strength=0)


OWN_RULES = [word_rule("block", w) for w in SPAM_WORDS]
KINDS = {"host": word_rule, "path": path_word_rule, "site": site_rule}


def rules_from(table: DataFrame) -> tuple[list[Rule], str]:
    """The method's own rules of a table (verdict, kind, text), and a digest of them; the list is broadcast, so it is the caller's to bound.

    kind: host (a word of the host), path (words of the path that follow each other) or site (host, or host/path).
    """
    rows = sorted({(r["verdict"], r["kind"], r["text"]) for r in table.select("verdict", "kind", "text").collect()}, key=repr)
    for verdict, kind, text in rows:
        if verdict not in ("allow", "block") or kind not in KINDS or not TOKEN.search((text or "").lower()):
            raise ValueError(f"no rule: {verdict}, {kind}, {text}")
        if kind == "host" and not TOKEN.fullmatch(text):
            raise ValueError(f"a word of a host holds small letters and digits alone: {text}")
    digest = hashlib.sha256("\n".join("\t".join(r) for r in rows).encode()).hexdigest()
    return [KINDS[kind](verdict, text) for verdict, kind, text in rows], digest


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, list[int]]:
    """Places in rules by the rarest token, counted over all URLs; ties go to the longer token, rules without one to ''."""
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    text = F.lower(F.concat("host", F.lit(" "), "path"))
    tokens = urls.select(F.explode(F.split(text, "[^a-z0-9]+")).alias("token")).join(F.broadcast(wanted), "token", "left_semi")
    seen = {r[0]: r[1] for r in tokens.groupBy("token").count().collect()}  # tokens of the rule list alone
    index: dict[str, list[int]] = {}
    for at, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t), default=""), []).append(at)
    return index


class Judge:
    """Verdicts of URLs; an expression is compiled when a URL first fetches it."""

    def __init__(self, rules: list[Rule], index: dict[str, list[int]]) -> None:
        self.rules, self.index = rules, index
        self.always = index.get("", [])
        self.patterns: dict[int, re.Pattern[str]] = {}

    def fits(self, at: int, site: str) -> bool:
        if (pattern := self.patterns.get(at)) is None:
            pattern = self.patterns[at] = re.compile(self.rules[at].pattern, re.DOTALL)
        return pattern.match(site) is not None

    def __call__(self, host: str, path: str) -> tuple[str | None, str]:
        site = host + path
        fetched = [*self.always, *(at for t in set(TOKEN.findall(host + " " + path.lower())) for at in self.index.get(t, ()))]
        found = [at for at in fetched if self.fits(at, site)]
        base = min((at for at in found if self.rules[at].base), key=lambda at: (-self.rules[at].strength, at), default=None)
        if base is not None:
            return self.rules[base].name, self.rules[base].verdict
        return None, "block" if any(self.rules[at].verdict == "block" for at in found) else "allow"


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """id, host, path, rule (a base rule's name, else null) and verdict for each row."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    listed = [*BASE_RULES, *OWN_RULES] if rules is None else list(rules)
    sent = spark.sparkContext.broadcast(([astuple(r) for r in listed], rarest_tokens(urls, listed)))
    schema = schema_with(urls, "rule string, verdict string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, index = sent.value
        verdict = Judge([Rule(*r) for r in rows], index)
        for b in batches:
            found = [verdict(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield beside(b.columns, [pa.array(x, pa.string()) for x in ([r for r, _ in found], [v for _, v in found])], schema)

    return urls.mapInArrow(run, schema).withColumnRenamed("id", id_col)
