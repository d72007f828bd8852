"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over "host/path" with the literal tokens (runs of ASCII letters and digits) that any
match must hold whole.  The corpus is counted for the rules' tokens alone; each rule is filed under its rarest one.  A
URL's tokens then fetch its candidate rules, and only those run their expression.  Of the host rules that fit, the
longest wins; where none fits, a blocking pattern rule decides, else the URL is allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; path: from there up to ``?``, ``#`` or the
end.  Defined results: a null URL, or one without ``://``, has empty host and path, no rule, and is allowed.  Repeated
rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from turnstile.llm import common as cm

#: verdict, host/path: a host with its subdomains, and the beginning of a path.
HOST_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Expressions over host/path that block, with the literals any match holds as whole tokens.
PATTERN_RULES = (
    (r"(^|[.-])spam-[^/]*/", ("spam",)),
    (r"(^|\.)cheap-pills\.[^/]*/", ("cheap", "pills")),
    (r"(^|[.-])casino[.-][^/]*/", ("casino",)),
    (r"(^|[.-])bets\.[^/]*/", ("bets",)),
    (r"(^|\.)adult-[^/]*/", ("adult",)),
    (r"(^|\.)ads-track\.[^/]*/", ("ads", "track")),
    (r"^[^/]*/(?:[^/]*/)*wp-login\.php$", ("wp", "login", "php")),
)

_TOKEN = re.compile(r"[A-Za-z0-9]+")
_A_TO_Z = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str | None  # None: a pattern rule
    pattern: str
    literals: tuple[str, ...]


def host_rule(verdict: str, name: str) -> Rule:
    """The last path token may go on in the URL, so it is a literal only where a separator ends it."""
    host, _, path = name.partition("/")
    whole = _TOKEN.findall(host) + [m[0] for m in _TOKEN.finditer(f"/{path}") if m.end() < len(path) + 1]
    return Rule(verdict, name, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(whole))


RULES = tuple(host_rule(*r) for r in HOST_RULES) + tuple(Rule("block", None, p, lits) for p, lits in PATTERN_RULES)


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_A_TO_Z), slash + path


def token_counts(urls: DataFrame, tokens: frozenset[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; a row a token reaches the driver."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for url in batch["url"].to_pylist():
                host, path = split_url(url)
                counts.update(tokens.intersection(_TOKEN.findall(host + path)))
        yield cm.record_batch(["token", "n"], [list(counts), list(counts.values())], [pa.string(), pa.int64()])

    return {t: n for t, n in urls.mapInArrow(run, "token string, n long").groupBy("token").sum("n").collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal; '' has those without one."""
    out = defaultdict(list)
    for r in rules:
        out[min(r.literals, key=lambda t: (counts.get(t, 0), t), default="")].append(r)
    return dict(out)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    pages = cm.with_columns(pages, page_id="long", url="string")
    filed = index(rules, token_counts(pages.select("url"), frozenset(t for r in rules for t in r.literals)))

    def run(batches):
        compiled = {t: [(r, re.compile(r.pattern)) for r in rs] for t, rs in filed.items()}
        always = compiled.get("", [])
        for batch in batches:
            out = []
            for url in batch["url"].to_pylist():
                host, path = split_url(url)
                text = host + (path if path else "/")
                best, blocked = None, False
                if host:
                    tokens = compiled.keys() & set(_TOKEN.findall(host + path))
                    for r, p in [x for t in tokens for x in compiled[t]] + always:
                        if p.search(text):
                            if r.name is None:
                                blocked = True
                            elif path and (best is None or len(r.name) > len(best.name)):
                                best = r
                out.append((host, path, best.name if best else None, best.verdict if best else "block" if blocked else "allow"))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch["page_id"], *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(cm.read_table(spark, sf_dir, "pages"))


def oracle() -> str:
    rules = sorted(HOST_RULES, key=lambda r: -len(r[1]))
    fits = [(f"(h = '{n.partition('/')[0]}' OR ends_with(h, '.{n.partition('/')[0]}')) AND starts_with(p, '/{n.partition('/')[2]}')", v, n) for v, n in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, _, n in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v, _ in fits)
    blocked = " OR ".join(f"regexp_matches(t, '{p}')" for p, _ in PATTERN_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS r FROM pages),
b AS (SELECT page_id, coalesce({lower.format("regexp_extract(r, '^[^/]*')")}, '') AS h, coalesce(regexp_replace(r, '^[^/]*', '', 's'), '') AS p FROM a),
c AS (SELECT *, h || CASE WHEN p = '' THEN '/' ELSE p END AS t FROM b)
SELECT page_id, h AS host, p AS path, {rule} AS rule, {verdict} WHEN h <> '' AND ({blocked}) THEN 'block' ELSE 'allow' END AS verdict FROM c"""
