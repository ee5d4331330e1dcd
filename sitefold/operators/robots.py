"""robots.txt: sitemap directives (R1), rule parsing (R2) and allow decisions.

Parsing is one ``aggregate`` fold per file over its lines (robots files are small), giving
ordered groups; decisions are an equi join on ``site`` with a residual path-prefix test, then
the first matching rule per url (``min_by``).  Paths are compared percent-decoded on both sides,
which orders like comparing both re-quoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions import urls as U
from sitefold.functions.text import py_strip

# line breaks of str.splitlines()
LINE_SPLIT_RE = "\\r\\n|[\\n\\r\\x{0B}\\f\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"


def robot_lines(robots: DataFrame) -> Column:
    """Lines of the robots text of a 200 reply (other statuses and missing text: no lines)."""
    ok = (F.col("status") == 200) & F.col("text").isNotNull()
    return F.when(ok, F.split(F.col("text"), LINE_SPLIT_RE, -1)).otherwise(F.array().cast("array<string>"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(site, pos, sitemap_url) for every line whose stripped lower form starts with
    'sitemap:'; the rest stripped, empty values dropped; any position in the file."""
    lines = robots.select("site", F.posexplode(robot_lines(robots)).alias("ln", "line"))
    lines = lines.withColumn("s", py_strip(F.col("line")))
    hits = lines.filter(F.lower(F.col("s")).startswith("sitemap:"))
    hits = hits.withColumn("sitemap_url", py_strip(F.substring(F.col("s"), 9, 1 << 30))).filter(F.col("sitemap_url") != "")
    w = F.row_number().over(Window.partitionBy("site").orderBy("ln"))
    return hits.select("site", (w - 1).cast("int").alias("pos"), "sitemap_url")


def _unquote(c: Column) -> Column:
    """Percent-decoding that leaves '+' alone; an invalid escape keeps the raw text."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def robots_rules(robots: DataFrame) -> DataFrame:
    """R2: robots_rules(site, group_no, is_default, agents, rule_no, allow, path).

    Group rules (stdlib parser): a user-agent line after a rule line starts a new group; a line that
    is truly empty ends a group that has rules and drops agents that have none; '#' starts a
    comment; crawl-delay / request-rate count as rule lines; values are percent-decoded; an empty
    Disallow allows everything.  The first group naming '*' is the default group (later '*'
    groups are dropped).  Paths are re-parsed as URLs (query / params kept, fragment dropped).
    """
    lines = robot_lines(robots)
    cut = F.transform(lines, lambda raw: F.struct((raw == "").alias("blank"),
                                                   F.split(py_strip(F.split(raw, "#", 2)[0]), ":", 2).alias("kv")))
    parsed = F.transform(cut, lambda c: F.struct(
        c["blank"].alias("blank"),
        F.lower(py_strip(F.try_element_at(c["kv"], F.lit(1)))).alias("key"),
        F.when(F.size(c["kv"]) == 2, _unquote(py_strip(F.try_element_at(c["kv"], F.lit(2))))).alias("val"),
    ))
    empty_rules = F.array().cast("array<struct<allow:boolean,path:string>>")
    empty_agents = F.array().cast("array<string>")
    empty_groups = F.array().cast("array<struct<agents:array<string>,rules:array<struct<allow:boolean,path:string>>>>")
    init = F.struct(F.lit(0).alias("state"), empty_agents.alias("agents"), empty_rules.alias("rules"), empty_groups.alias("groups"))

    def add(a: Column) -> Column:
        return F.concat(a["groups"], F.array(F.struct(a["agents"].alias("agents"), a["rules"].alias("rules"))))

    def step(a: Column, x: Column) -> Column:
        is_rule_key = x["key"].isin("disallow", "allow", "crawl-delay", "request-rate")
        rule = F.struct((x["key"] == "allow").alias("allow"), x["val"].alias("path"))
        new_rules = F.when(x["key"].isin("disallow", "allow"), F.concat(a["rules"], F.array(rule))).otherwise(a["rules"])
        blank = F.when(a["state"] == 1, F.struct(F.lit(0).alias("state"), empty_agents.alias("agents"), empty_rules.alias("rules"), a["groups"].alias("groups"))) \
            .when(a["state"] == 2, F.struct(F.lit(0).alias("state"), empty_agents.alias("agents"), empty_rules.alias("rules"), add(a).alias("groups"))) \
            .otherwise(a)
        agent = F.when(a["state"] == 2, F.struct(F.lit(1).alias("state"), F.array(x["val"]).alias("agents"), empty_rules.alias("rules"), add(a).alias("groups"))) \
            .otherwise(F.struct(F.lit(1).alias("state"), F.concat(a["agents"], F.array(x["val"])).alias("agents"), a["rules"].alias("rules"), a["groups"].alias("groups")))
        rule_step = F.when(a["state"] != 0, F.struct(F.lit(2).alias("state"), a["agents"].alias("agents"), new_rules.alias("rules"), a["groups"].alias("groups"))).otherwise(a)
        keyed = F.when(x["val"].isNull(), a).when(x["key"] == "user-agent", agent).when(is_rule_key, rule_step).otherwise(a)
        return F.when(x["blank"], blank).otherwise(keyed)

    def finish(a: Column) -> Column:
        return F.when(a["state"] == 2, add(a)).otherwise(a["groups"])

    groups = robots.select("site", F.aggregate(parsed, init, step, finish).alias("groups"))
    g = groups.select("site", F.posexplode("groups").alias("gi", "g"))
    g = g.withColumn("is_default", F.array_contains(F.col("g.agents"), "*"))
    # only the first '*' group is kept
    g = g.withColumn("_fd", F.min(F.when(F.col("is_default"), F.col("gi"))).over(Window.partitionBy("site")))
    g = g.filter(~F.col("is_default") | (F.col("gi") == F.col("_fd"))).drop("_fd")
    r = g.select("site", F.col("gi").cast("int").alias("group_no"), "is_default", F.col("g.agents").alias("agents"),
                 F.posexplode_outer("g.rules").alias("rule_no", "rule"))
    r = r.select("site", "group_no", "is_default", "agents", F.col("rule_no").cast("int").alias("rule_no"),
                 F.col("rule.allow").alias("allow"), F.col("rule.path").alias("raw_path"))
    r = U.add_url_parts(r, "raw_path", "p")
    r = r.withColumn("path", U.unsplit(U.part("p", "scheme"), U.part("p", "netloc"), U.part("p", "path"), U.part("p", "params"),
                                       U.part("p", "query"), U.part("p", "fragment")))
    r = U.drop_url_parts(r, "p")
    r = r.withColumn("allow", F.when(F.col("raw_path") == "", F.lit(True)).otherwise(F.col("allow")))
    return r.drop("raw_path")


def chosen_groups(rules: DataFrame, agent: str) -> DataFrame:
    """(site, group_no) of the group that applies to ``agent``: the first non-default group with
    an agent token contained in our lower-cased agent name (text before '/'), else the default
    group."""
    name = agent.split("/")[0].lower()
    groups = rules.select("site", "group_no", "is_default", "agents").distinct()
    match = F.exists("agents", lambda t: F.instr(F.lit(name), F.lower(t)) > 0)
    groups = groups.filter(F.col("is_default") | match)
    return groups.groupBy("site").agg(F.min(F.struct("is_default", "group_no")).alias("k")).select("site", F.col("k.group_no").alias("group_no"))


def url_path_key(df: DataFrame, url: str, out: str) -> DataFrame:
    """The url as robots rules see it: decoded path;params?query#fragment ('/' when empty)."""
    df = df.withColumn("_dec", _unquote(F.col(url)))
    df = U.add_url_parts(df, "_dec", "q")
    key = U.unsplit(F.lit(""), F.lit(""), U.part("q", "path"), U.part("q", "params"), U.part("q", "query"), U.part("q", "fragment"))
    df = df.withColumn(out, F.regexp_replace(key, "^$", "/"))
    return U.drop_url_parts(df, "q").drop("_dec")


def robots_decisions(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``urls`` (site, url, ...) + ``allowed``: the first rule (file order) of the chosen group
    whose path is a prefix of the url's path key wins; no rule, no group or no robots -> allowed.

    A robots file is one bounded text, so the chosen group's rules are one array per site: the urls
    join it once, and the first match is found in the array.
    """
    active = rules.join(chosen_groups(rules, agent), ["site", "group_no"]).filter(F.col("rule_no").isNotNull())
    listed = active.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("rule_no", "allow", "path"))).alias("_rules"))
    keyed = url_path_key(urls, url, "_pq").join(listed, "site", "left")
    first = F.try_element_at(F.filter("_rules", lambda r: F.col("_pq").startswith(r["path"])), F.lit(1))
    return keyed.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("_pq", "_rules")
