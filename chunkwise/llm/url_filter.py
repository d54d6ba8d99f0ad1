"""URL filter with a token index.

Every rule is a pattern over a URL, and every rule has literal tokens (runs of
a-z and 0-9) that each URL it fits must contain whole. A rule is filed under the
rarest of its tokens, counted over the URLs at hand; a URL's own tokens look up
candidate rules, and regular expressions run on those only. Rules without any whole
token are filed under a key that every URL asks for.

Up to ``LITERALS`` rules the index is a literal array of hash buckets, so a lookup is one
array access and the filter needs no join, shuffle or Python: each URL is judged where
it is read. More rules than that are a table: the tokens of the distinct URLs are joined
with the rules' tokens, and the verdicts with the URLs. Both ways give the same.

Rules come as prefixes of host and path (``prefix_rule``) or as lines of a filter list
(``pattern_rule``, ``load``): ``||`` stands for the beginning of the host or of one of
its parent domains, ``|`` for the beginning or the end of the URL, ``*`` for anything,
``^`` for a separator or the end; ``@@`` before all makes a rule that allows. The
method's own rules (``SPAM``) are pairs and single words in a host's labels.

Defined results: a null URL and one without ``://`` have an empty host and path, no
rule and the default verdict; a very long URL is judged whole; repeated rows are judged
alike; an empty table gives an empty result. When several rules fit, the longest wins,
then the alphabetically last, then block before allow; of rules without a name, which
count as shortest, block. Columns called like the new ones (in any letter case) are
replaced; others are carried, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.llm._common import ascii_lower, fresh, quoted

#: Rules in one literal index, and in all literal indexes.
CHUNK, LITERALS = 4096, 20_000
#: Filed here: rules without a whole token.
ANY = ""


@dataclass(frozen=True)
class Rule:
    """``name`` is what the result shows, None for a rule that gives a verdict only.
    ``pattern`` runs against ``host + path``; ``tokens`` are whole tokens of every URL that fits."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def prefix_rule(spec: str, verdict: str) -> Rule:
    """A rule like ``example.org/en/1``: the host and its subdomains, and paths that start so."""
    host, slash, path = spec.partition("/")
    if not host or not slash:
        raise ValueError(f"a rule needs a host and a path: {spec!r}")
    whole = re.findall("[a-z0-9]+", host.lower())
    # the last token of the path may go on in the URL, so it isn't whole
    whole += re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(spec, verdict, rf"^(?:[^/]*\.)?{re.escape(host.lower())}/{re.escape(path)}", tuple(dict.fromkeys(whole)))


def label_rule(*words: str, verdict: str = "block") -> Rule:
    """A rule for hosts of which a label, but the last, has all these words, whole; it gives a verdict without a name."""
    inside = "".join(rf"(?=[^./]*(?<![a-z0-9]){re.escape(w)}(?![a-z0-9]))" for w in words)
    return Rule(None, verdict, rf"^(?:[^/]*\.)?{inside}[^./]*\.", words)


def pattern_rule(line: str) -> Rule:
    """A rule from a line of a filter list; its name is the line."""
    verdict, pattern = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
    if "$" in pattern or not pattern.strip("|*^"):
        raise ValueError(f"a rule without options that names something is needed: {line!r}")
    lead = next((p for p in ("||", "|") if pattern.startswith(p)), "")
    body = pattern[len(lead) :]
    end, body = ("$", body[:-1]) if body.endswith("|") else ("", body)
    host, slash, path = body.partition("/")
    body = host.lower() + slash + path  # paths keep their letters' case, as hosts don't
    parts = {"*": ".*", "^": "(?:[^a-zA-Z0-9_.%-]|$)"}
    regex = {"": "", "|": "^", "||": r"^(?:[^/]*\.)?"}[lead] + "".join(parts.get(c, re.escape(c)) for c in body) + end
    # a token is whole where something stands on either side that isn't part of it: a character, an anchor, no wildcard
    whole = re.findall("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", body.lower())
    if not lead and whole and body.lower().startswith(whole[0]):
        whole = whole[1:]
    if not end and whole and body.lower().endswith(whole[-1]):
        whole = whole[:-1]
    return Rule(line, verdict, regex, tuple(dict.fromkeys(whole)))


def load(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a filter list, a line each; empty lines and those that begin with ! or # or [ are left out.

    A list is the query's, not the corpus's: the driver holds it."""
    lines = (r["value"].strip() for r in spark.read.text(path).toLocalIterator())
    return [pattern_rule(line) for line in dict.fromkeys(lines) if line and line[0] not in "!#["]


#: The rules of the contract.
CONTRACT = (
    prefix_rule("org/", "allow"),
    prefix_rule("example.org/es/", "block"),
    prefix_rule("example.org/en/1", "block"),
    prefix_rule("com/fr/", "allow"),
    prefix_rule("com/de/", "block"),
)
#: Words that tell in a label by themselves, and words of which a label must have two.
STRONG = (
    "adult", "bets", "betting", "camgirls", "casino", "casinos", "cialis", "clickbait", "escorts", "gambling", "hentai", "jackpot", "lottery", "malware", "nudes", "payday",
    "phishing", "pills", "poker", "porn", "porno", "replica", "roulette", "sexcam", "slots", "spam", "spyware", "viagra", "warez", "webcams", "xxx",
)
WEAK = (
    "ads", "bonus", "buy", "cash", "cheap", "click", "coin", "credit", "crack", "deals", "discount", "earn", "farm", "free", "loan", "loans", "meds", "money", "offers",
    "online", "pharmacy", "prize", "promo", "seo", "sex", "torrent", "track", "tracker", "tracking", "traffic", "videos", "win", "winner",
)
#: The method's own rules, for URLs that no named rule fits: labels of spam sites' hosts.
SPAM = (*(label_rule(w) for w in STRONG), *(label_rule(a, b) for a, b in combinations(WEAK, 2)))


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.regexp_replace(ascii_lower(F.concat_ws("/", host, path)), "[^a-z0-9]+", " "), " ")), lambda t: t != "")


def token_counts(urls: DataFrame, url_col: str, rules: Iterable[Rule]) -> dict[str, int]:
    """In how many URLs each token of a rule stands; no more rows than rule tokens reach the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    url = F.col(quoted(url_col))
    # the rules' tokens that a URL has, found where it is read; one row per token and task is shuffled
    found = urls.select(F.explode(F.array_intersect(tokens_of(host_of(url), path_of(url)), F.lit(wanted))).alias("t"))
    return {r["t"]: r["count"] for r in found.groupBy("t").count().collect()}


def _key(rule: Rule, counts: dict[str, int]) -> str:
    """The rarest token of a rule."""
    return min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=ANY)


BUCKET = "array<struct<key:string,pattern:string,length:int,order:string,name:string,verdict:string>>"


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """An array of buckets; bucket ``crc32(token) mod size`` holds the rules filed under the token."""
    size = 2 * len(rules)
    buckets: list[list[Column]] = [[] for _ in range(size)]
    for r in rules:
        key = _key(r, counts)
        cells = (key, r.pattern, len(r.name or ""), r.name or "", r.name, r.verdict)
        buckets[zlib.crc32(key.encode()) % size].append(F.struct(*map(F.lit, cells)))
    return F.array(*[F.array(*b).cast(BUCKET) for b in buckets]), size


def _lookup(index: Column, size: int) -> Callable[[Column], Column]:
    def candidates(token: Column) -> Column:
        bucket = F.get(index, F.pmod(F.crc32(token.cast("binary")), F.lit(size)).cast("int"))
        return F.filter(bucket, lambda r: r["key"] == token)

    return candidates


def _ranked(rule: Column) -> Column:
    """What of a rule decides, first things first."""
    return F.struct(*[rule[c].alias(c) for c in ("length", "order", "verdict", "name")])


def _by_literals(url: Column, rules: list[Rule], counts: dict[str, int]) -> Column:
    """The rule that wins, from literal indexes."""
    host, path = host_of(url), path_of(url)
    target, tokens = F.concat(host, path), F.concat(tokens_of(host, path), F.array(F.lit(ANY)))
    best = []
    for at in range(0, len(rules), CHUNK):
        index, size = _index(rules[at : at + CHUNK], counts)

        fits = F.filter(F.flatten(F.transform(tokens, _lookup(index, size))), lambda r: F.regexp_like(target, r["pattern"]))
        best.append(F.array_max(F.transform(fits, _ranked)))
    return F.array_max(F.array(*best))


def _by_join(urls: DataFrame, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    """Rows (url, won) of the distinct ``url``s that any rule fits, from a table of rules."""
    rows = [(_key(r, counts), r.pattern, len(r.name or ""), r.name or "", r.name, r.verdict) for r in rules]
    table = urls.sparkSession.createDataFrame(rows, BUCKET.removeprefix("array<struct<").removesuffix(">>"))
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    tokens = F.concat(tokens_of(host, path), F.array(F.lit(ANY)))
    asked = urls.distinct().select("url", F.concat(host, path).alias("target"), F.explode(tokens).alias("key"))
    fits = asked.join(table, "key").where(F.regexp_like("target", F.col("pattern")))
    return fits.groupBy("url").agg(F.max(F.struct("length", "order", "verdict", "name")).alias("won"))


def judge(urls: DataFrame, url_col: str, rules: Iterable[Rule], default: str = "allow", counts: dict[str, int] | None = None) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict`` (which replace columns of these names).

    ``counts`` (URLs per token) may be given, else they are counted here over all rows.
    """
    rules = list(dict.fromkeys(rules))
    if counts is None:
        counts = token_counts(urls, url_col, rules)
    url = F.col(quoted(url_col))
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in urls.columns if c.lower() not in new]
    won, key, held = fresh(urls.select(*map(quoted, kept), *(F.lit(0).alias(n) for n in new)), "_won", "_url", "_held")
    cols = [F.col(quoted(c)) for c in kept]
    judged = urls.select(*cols, host_of(url).alias("host"), path_of(url).alias("path"), url.alias(key))
    kind = "struct<length:int,order:string,verdict:string,name:string>"
    if not rules:
        judged = judged.withColumn(won, F.lit(None).cast(kind))
    elif len(rules) <= LITERALS:
        judged = judged.withColumn(won, _by_literals(F.col(key), rules, counts))
    else:
        found = _by_join(judged.select(F.col(key).alias("url")).where("url IS NOT NULL"), rules, counts)
        judged = judged.join(found.select(F.col("url").alias(held), F.col("won").alias(won)), F.col(key) == F.col(held), "left")
    return judged.select(*cols, "host", "path", F.col(f"{won}.name").alias("rule"), F.coalesce(F.col(f"{won}.verdict"), F.lit(default)).alias("verdict"))
