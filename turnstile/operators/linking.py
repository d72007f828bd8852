"""Linking comments to fixtures: evidence as column expressions, a bucketed band join, a confidence score."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions.exprs import mentions, require_columns

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Team:
    name: str
    aliases: tuple[str, ...]
    communities: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rivalry:
    teams: tuple[str, str]
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class LinkingConfig:
    """Teams with aliases and home communities, rivalries with keywords, communities where any fixture counts."""

    teams: tuple[Team, ...]
    rivalries: tuple[Rivalry, ...] = ()
    generic: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict) -> LinkingConfig:
        """From a parsed configuration; a team without aliases is skipped with a warning, a rivalry without keywords too."""
        teams, rivalries = [], []
        for name, spec in (raw.get("teams") or {}).items():
            aliases = tuple(str(a).lower() for a in (spec or {}).get("aliases") or ())
            if not aliases:
                log.warning("team %s has no aliases; skipped", name)
                continue
            teams.append(Team(name, aliases, tuple(s.lower() for s in spec.get("home_subreddits") or ())))
        for spec in (raw.get("rivalries") or {}).values():
            if spec.get("keywords"):
                rivalries.append(Rivalry(tuple(spec["teams"]), tuple(k.lower() for k in spec["keywords"])))
        return cls(tuple(teams), tuple(rivalries), tuple(s.lower() for s in raw.get("generic_football_subreddits") or ()))

    @classmethod
    def from_yaml(cls, path: str) -> LinkingConfig:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f))


@dataclass(frozen=True)
class LinkerOptions:
    before_hours: float = 48
    after_hours: float = 48
    min_confidence: float = 0.40
    both_teams: float = 0.60
    one_team: float = 0.35
    rivalry_bonus: float = 0.25
    home_bonus: float = 0.25
    generic_bonus: float = 0.10
    #: Fixtures go to every task while a count finds no more than these; else both sides are dealt by key.
    broadcast_rows: int = 100_000


def any_mention(body: Column, words: tuple[str, ...]) -> Column:
    hits = [mentions(body, w) for w in sorted(words, key=lambda w: (-len(w), w))]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def team_hits(body: Column, community: Column, config: LinkingConfig) -> list[Column]:
    """For each team, whether the text mentions it or its home community is this one; never null."""
    found = []
    for t in config.teams:
        hit = any_mention(body, t.aliases)
        if t.communities:
            hit = hit | F.lower(community).isin(*t.communities)
        found.append(F.coalesce(hit, F.lit(False)))
    return found


def detect_teams(body: Column, community: Column, config: LinkingConfig) -> Column:
    """Names of the teams that the text mentions or whose home community this is."""
    found = [F.when(hit, t.name) for hit, t in zip(team_hits(body, community, config), config.teams, strict=True)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def keys_by_words(config: LinkingConfig) -> dict[tuple[str, ...], list[str]]:
    """Keys of the rivalries by their keywords."""
    by_words: dict[tuple[str, ...], list[str]] = {}
    for r in config.rivalries:
        by_words.setdefault(r.keywords, []).append("|".join(sorted(r.teams)))
    return by_words


def word_hits(body: Column, config: LinkingConfig) -> list[Column]:
    """For each set of rivalry keywords, whether the text has one of them; never null."""
    return [F.coalesce(any_mention(body, w), F.lit(False)) for w in keys_by_words(config)]


def detect_rivalries(body: Column, config: LinkingConfig) -> Column:
    """Keys of the rivalries whose keyword the text has."""
    empty = F.array().cast("array<string>")
    found = [F.when(hit, F.array(*map(F.lit, keys))).otherwise(empty) for hit, keys in zip(word_hits(body, config), keys_by_words(config).values(), strict=True)]
    return F.array_distinct(F.concat(*found)) if found else empty


def band_join(points: DataFrame, anchors: DataFrame, at: str, centre: str, before: float, after: float, strategy: str = "auto", broadcast_rows: int = 100_000) -> DataFrame:
    """Pairs with centre - before <= at <= centre + after (inclusive), for sides that share nothing but time.

    Few anchors (counted first) are sent to every task.  Beyond that, time is cut into buckets as wide as the band; an
    anchor goes to the two or three buckets its band touches and the sides meet by an equi-join, which shuffles each
    point once and lets skewed buckets be split.
    """
    inside = F.col(at).between(F.col(centre) - before, F.col(centre) + after)
    if strategy == "auto":
        strategy = "broadcast" if anchors.limit(broadcast_rows + 1).count() <= broadcast_rows else "bucket"
    if strategy == "broadcast":
        return points.join(F.broadcast(anchors), inside)
    return in_bucket(points, at, before, after).join(in_buckets(anchors, centre, before, after), "__bucket").filter(inside).drop("__bucket")


def in_bucket(points: DataFrame, at: str, before: float, after: float) -> DataFrame:
    """points with __bucket, the one that their time falls in; a bucket is as wide as the band."""
    return points.withColumn("__bucket", F.floor(F.col(at) / max(1, int(before + after))))


def in_buckets(anchors: DataFrame, centre: str, before: float, after: float) -> DataFrame:
    """anchors once for each of the two or three buckets that their band touches."""
    first, last = (F.floor((F.col(centre) + s) / max(1, int(before + after))) for s in (-before, after))
    return anchors.withColumn("__bucket", F.explode(F.sequence(first, last)))


def confidence(options: LinkerOptions, home: Column, away: Column, rivalry: Column, home_community: Column, generic: Column) -> tuple[Column, Column]:
    """(unrounded score held to 1, reasons joined by ;)"""
    both, one = home & away, home != away
    score = F.when(both, options.both_teams).when(one, options.one_team).otherwise(0.0) + F.when(rivalry, options.rivalry_bonus).otherwise(0.0)
    score = score + F.when(home_community, options.home_bonus).when(generic, options.generic_bonus).otherwise(0.0)
    reasons = F.concat_ws(
        ";",
        F.when(both, "both_teams_mentioned").when(home, "home_mentioned").when(away, "away_mentioned"),
        F.when(rivalry, "rivalry_keyword"),
        F.when(home_community, "team_home_subreddit").when(generic, "generic_football_subreddit"),
    )
    return F.least(score, F.lit(1.0)), reasons


def link(comments: DataFrame, fixtures: DataFrame, config: LinkingConfig, options: LinkerOptions = LinkerOptions()) -> DataFrame:
    """One row a comment and fixture that evidence ties together.

    comments: id, body, subreddit, created_utc; fixtures: match_id, home_team, away_team, match_epoch.  Evidence is
    computed once a comment.  Each mentioned team and each rivalry is a key; a fixture has its two teams and their pair
    for keys, and the sides meet by (key, time bucket), so that a comment sees only fixtures it has evidence for.  A
    pair found by several keys counts under the first of home team, away team, rivalry.  A null team name is never
    mentioned.  Few fixtures (counted first) are sent to every task; beyond that both sides are dealt by key, where
    adaptive execution splits those of popular teams.
    """
    require_columns(comments, ["id", "body", "subreddit", "created_utc"], "comments")
    require_columns(fixtures, ["match_id", "home_team", "away_team", "match_epoch"], "fixtures")
    seen = keyed(comments.select("id", "subreddit", "created_utc", detect_teams(F.col("body"), F.col("subreddit"), config).alias("teams_hit"), detect_rivalries(F.col("body"), config).alias("rivalries_hit")))
    before, after = options.before_hours * 3600, options.after_hours * 3600
    side = in_buckets(sides(fixtures.select("match_id", "home_team", "away_team", "match_epoch"), config), "match_epoch", before, after)
    few = fixtures.limit(options.broadcast_rows + 1).count() <= options.broadcast_rows
    near = in_bucket(seen, "created_utc", before, after).join(F.broadcast(side) if few else side.hint("merge"), ["key", "__bucket"])
    near = near.filter(F.col("created_utc").between(F.col("match_epoch") - before, F.col("match_epoch") + after))
    scored = judged(near, config, options)
    return scored.select("match_id", F.col("id").alias("comment_id"), "subreddit", "created_utc", "match_epoch", ((F.col("created_utc") - F.col("match_epoch")) / 60.0).alias("minutes_from_kickoff"), "link_reasons", "link_confidence")


def _team_key(x: Column) -> Column:
    return F.concat(F.lit("t"), x)


def _pair_of(x: Column) -> Column:
    return F.concat(F.lit("p"), x)


def keyed(seen: DataFrame) -> DataFrame:
    """Rows with teams_hit and rivalries_hit, once for each of them, with its key."""
    # The outer form keeps the optimizer from a filter that would evaluate all the evidence a second time.
    return seen.withColumn("key", F.explode_outer(F.concat(F.transform("teams_hit", _team_key), F.transform("rivalries_hit", _pair_of)))).filter("key IS NOT NULL")


def sides(fixtures: DataFrame, config: LinkingConfig) -> DataFrame:
    """Fixtures with pair and communities, once for each of their keys: the two teams and the pair."""
    homes = {t.name: list(t.communities) for t in config.teams if t.communities}
    of_team = F.create_map(*(x for k, v in homes.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if homes else F.lit(None).cast("map<string,array<string>>")
    side = fixtures.withColumn("pair", pair_key(F.col("home_team"), F.col("away_team")))
    side = side.withColumn("communities", F.concat(*(F.coalesce(F.try_element_at(of_team, F.col(c)), F.array().cast("array<string>")) for c in ("home_team", "away_team"))))
    return side.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(_team_key(F.col("home_team")), _team_key(F.col("away_team")), _pair_of(F.col("pair")))))))


def judged(near: DataFrame, config: LinkingConfig, options: LinkerOptions) -> DataFrame:
    """Of rows of keyed() that met rows of sides(), one a pair, with link_reasons and a link_confidence that suffices."""
    home, away = (F.coalesce(F.array_contains("teams_hit", F.col(c)), F.lit(False)) for c in ("home_team", "away_team"))
    rivalry = F.array_contains("rivalries_hit", F.col("pair"))
    near = near.filter(F.col("key") == F.when(home, _team_key(F.col("home_team"))).when(away, _team_key(F.col("away_team"))).otherwise(_pair_of(F.col("pair"))))
    community = F.lower("subreddit")
    generic = community.isin(*config.generic) if config.generic else F.lit(False)
    score, reasons = confidence(options, home, away, rivalry, F.array_contains("communities", community), generic)
    return near.withColumns({"raw": score, "link_reasons": reasons}).filter(F.col("raw") >= options.min_confidence).withColumn("link_confidence", F.round("raw", 3)).drop("raw")


def coverage(links: DataFrame, comments: DataFrame, least: float = 0.95) -> float:
    """The share of links whose comment is in comments (1 without links); a share below least is logged."""
    known = comments.select(F.col("id").alias("comment_id")).distinct().withColumn("known", F.lit(1))
    n, found = links.select("comment_id").join(known, "comment_id", "left").agg(F.count("*"), F.count("known")).first()
    share = found / n if n else 1.0
    if share < least:
        log.warning("only %.1f %% of %d links find their comment", 100 * share, n)
    return share


# Shorthand words of seven teams.
TEAM_SHORTHAND = {
    "Barcelona": ["barca", "fcb"],
    "Real Madrid": ["madrid", "rma"],
    "Manchester United": ["united", "manu", "mufc"],
    "Manchester City": ["city", "mcfc"],
    "Liverpool": ["lfc"],
    "Arsenal": ["arsenal", "afc"],
    "Tottenham Hotspur": ["spurs", "thfc"],
}


def team_keywords(team: Column, shorthand: dict[str, list[str]]) -> Column:
    """ASCII words of the name longer than three letters, lower-cased, with the team's shorthand words."""
    words = F.transform(F.filter(F.regexp_extract_all(team, F.lit("[a-zA-Z]+"), 0), lambda w: F.length(w) > 3), F.lower)
    extra = F.lit(None).cast("array<string>")
    if shorthand:
        extra = F.try_element_at(F.create_map(*(x for k, v in shorthand.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), team)
    return F.array_distinct(F.concat(words, F.coalesce(extra, F.array().cast("array<string>"))))


def first_match(items: DataFrame, fixtures: DataFrame, shorthand: dict[str, list[str]] | None = None) -> DataFrame:
    """items (external_id, comment) with the first fixture, by ordinal, both of whose sides occur as substrings.

    shorthand adds words to a team's own; TEAM_SHORTHAND unless another table is given.

    Of fixtures with the same words only the first can be found, so one for each pair of word lists is gathered into a
    sorted array, which is sent to every task and grows with the pairs of teams, not with the fixtures.
    """
    sides = fixtures.select("ordinal", "match_id", *(team_keywords(F.col(c), TEAM_SHORTHAND if shorthand is None else shorthand).alias(k) for c, k in (("home_team", "h"), ("away_team", "a"))))
    firsts = sides.groupBy("h", "a").agg(F.min(F.struct("ordinal", "match_id")).alias("first")).select("first.*", "h", "a")
    listed = F.broadcast(firsts.agg(F.array_sort(F.collect_list(F.struct("ordinal", "match_id", "h", "a"))).alias("__fixtures")))
    text = F.lower(F.coalesce("comment", F.lit("")))
    has = lambda words: F.exists(words, lambda w: F.contains(text, w))
    hit = F.filter("__fixtures", lambda x: has(x["h"]) & has(x["a"]))
    return items.crossJoin(listed).withColumn("match_id", F.get(hit, 0)["match_id"]).drop("__fixtures")
