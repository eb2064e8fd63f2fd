"""Problem 5: the main body of read pages, without what their sites put around and into it.

Template deduction by equivalence classes. A token is a line with its numbers masked (facts and list items keep theirs).
Pages of one site (told by its navigation, or by the host of its links, as the cache holds no host) give each token an
occurrence vector: in which pages it stands, and how often. Tokens with the same vector form a class; a class that is
frequent among the site's pages is valid. A large class is a level of the site's template, and so is one that stands on
every page; a smaller one is nested in a level if all its pages hold that level and it always stands in the same gap
between the level's tokens. Levels and nested classes are the site's template, unless they look like slots (headings,
facts, items, varying numbers). Forms that are template wherever they are met on well-covered sites are template on sites
seen once, too. What the template leaves are the slots: the page's own title, headings, paragraphs, lists, captions and
facts. Headings of lists of links to other pages, and labels before one such link, are learned, too: behind the former
stand ever other short lines and hardly a paragraph, the latter stand apart from other facts, with ever other values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize, spread

_BULLET = re.compile(r"^(?:[-•*–]|\d{1,2}[.)])\s+")
_HASH = re.compile(r"^(#{1,6})\s+")
_LINK = re.compile(r"^(?:[-•*–]\s+)?\[[^\]]*\]\((?:https?:)?//([^/)\s]+)[^)]*\)$")
_CRUMB = re.compile(r"^[^.!?]{1,60}?(?:\s(?:/|»|>|›|→)\s[^/»>›→]{1,120}){1,6}$")
_CRUMB_CUT = re.compile(r"\s(?:/|»|>|›|→)\s")
_SEP = re.compile(r"\S\s+[|·•]\s+\S")
_FACT = re.compile(r"^([^\W\d_][\w '’]{0,28}?) ?: +\S.{0,80}$")
_END = re.compile(r"[.!?。！？][\"”»')\]]*$")
_CUT = re.compile(r"(?:\.\.\.|…)$")
_NUM = re.compile(r"\d+(?:[.,:]\d+)*")
_CAPTION = re.compile(r"^fig|^\[|[:,]", re.I)
_NAME = re.compile(r"\b[A-ZÀ-Þ][\w'’]*(?:\s+(?:of |von |de )?[A-ZÀ-Þ][\w'’]*)*")

#: Kinds of lines.
PARA, FACT, ITEM, CUT, SEP, LINK, CRUMB, SHORT = range(8)


def line_kind(line: str) -> int:
    """The kind of a stripped line by its shape alone."""
    if _LINK.match(line):
        return LINK
    bare = _HASH.sub("", line)
    bullet = _BULLET.match(bare)
    bare = _BULLET.sub("", bare)
    if _CUT.search(bare):
        return CUT
    if bullet:
        return ITEM
    if _END.search(bare) and (len(bare.split()) >= 4 or re.search(r"[。！？]", bare)):
        return PARA
    if _SEP.search(bare):
        return SEP
    if _CRUMB.match(bare):
        return CRUMB
    if _FACT.match(bare):
        return FACT
    return SHORT


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _form(token: str) -> str:
    """A token without its names and, if it is long, without its middle."""
    w = _NAME.sub("N", token).split()
    return " ".join(w if len(w) <= 8 else [*w[:3], "...", *w[-3:]])


#: A line's look in one number: its kind, the level of a heading mark, a bullet, the signs of a caption.
LEVEL, BULLET, CAPTION = 3, 1 << 6, 1 << 7
BUCKETS = 16
MOST_REMEMBERED = 200_000


def _read_line(x: str) -> tuple:
    """(look, kind, bare, h1, h2, exact, word, host) of a stripped line: h1 the masked token, h2 its form, exact the line with its numbers (0 without any), word whether it may be an item of a menu."""
    kind = line_kind(x)
    level = _HASH.match(x)
    bare = _HASH.sub("", x)
    bullet = _BULLET.match(bare)
    bare = _BULLET.sub("", bare)
    look = kind | (len(level.group(1)) if level else 0) << LEVEL | (BULLET if bullet else 0) | (CAPTION if _CAPTION.search(bare) else 0)
    digits = _NUM.search(bare)
    m1 = _NUM.sub("0", bare) if digits and kind not in (FACT, ITEM) else bare
    if kind in (PARA, SEP):
        form = _form(m1)
    elif kind == FACT:
        form = "label " + _FACT.match(bare).group(1).strip().lower()
    elif kind == SHORT:
        form = m1.strip().lower().rstrip(":")
    else:
        form = m1
    word = kind in (SHORT, ITEM) and len(bare.split()) == 1 and not any(c.isdigit() for c in bare)
    return look, kind, bare.strip(), _h(m1), _h(form), _h(bare) if digits else 0, word, _LINK.match(x).group(1).lower() if kind == LINK else None


def read_page(value: str, memo: dict[str, tuple] | None = None) -> tuple:
    """(site, no, look, h1, h2, rep, exact, near, crumbs) of a page.

    site is its key, None if nothing tells it: the host of its first link, or the items of its navigation, whatever comes
    first. The lists have an entry for each line that isn't blank: its number, look and tokens (see _read_line), how often
    the token stood before, the line's role among its neighbours: for a short line the bucket of the line behind it
    (from 1, if that is short, an item or cut), for a fact that stands apart from other facts its own, and with 32 added
    for a short line alone between body lines. crumbs are pairs of places: a path of names, and a later line of its last name.
    """
    memo = {} if memo is None else memo
    no, lines = [], []
    for k, raw in enumerate(value.split("\n"), 1):
        x = raw.strip()
        if x:
            got = memo.get(x)
            if got is None:
                if len(memo) >= MOST_REMEMBERED:
                    memo.clear()
                got = memo[x] = _read_line(x)
            no.append(k)
            lines.append(got)
    n = len(lines)
    key, menu = None, ()
    run: list[int] = []
    for k in range(n + 1):
        if k < n and lines[k][6]:
            run.append(k)
            continue
        if len(run) >= 3:
            menu = set(run)
            key = "nav " + " ".join(sorted(lines[j][2] for j in run))
            break
        run = []
        if k < n and lines[k][1] == LINK:
            key = "host " + lines[k][7]
            break
        if k < n and lines[k][1] == SEP:
            key = "nav " + " ".join(sorted(re.split(r"\s+[|·•]\s+", lines[k][2])))
            break
    h1 = [x[3] for x in lines]
    h2 = [x[4] for x in lines]
    for k in menu:  # a word of the menu plays another role than the same word as a heading
        h1[k] = h2[k] = _h("menu " + lines[k][2])
    times: dict[int, int] = {}
    rep, near = [], []
    for k, x in enumerate(lines):
        rep.append(times.get(h1[k], 0))
        times[h1[k]] = rep[-1] + 1
        before, after = lines[k - 1][1] if k else -1, lines[k + 1][1] if k + 1 < n else -1
        role = 0
        if x[1] == SHORT:
            if after in (SHORT, ITEM, CUT):
                role = 1 + h1[k + 1] % BUCKETS
            if before in (PARA, FACT, ITEM) and after == PARA:
                role += 32
        elif x[1] == FACT:
            role = 1 + h1[k] % BUCKETS if before != FACT and after != FACT else 0
        near.append(role)
    crumbs = []
    for k, x in enumerate(lines):
        if x[1] == CRUMB:
            name = _CRUMB_CUT.split(x[2])[-1].strip()
            same = [j for j in range(k + 1, n) if lines[j][2] == name]
            crumbs += [v for j in same or [-1] for v in (k, j)]
    return None if key is None else _h(key), no, [x[0] for x in lines], h1, h2, rep, [x[5] for x in lines], near, crumbs


#: What is known of a line's token: it is template; it may head a part; it heads a list of links; it labels one link.
TEMPLATE, HEAD, LINKS, ONE_LINK = 1, 2, 4, 8


def main_lines(no: list[int], look: list[int], known: dict[int, int], crumbs: list[int]) -> list[int]:
    """Numbers of the lines that aren't main body. known: the flags of each line's token by line number; no, look and crumbs as read_page() gives them."""
    n = len(no)
    flags = [known.get(x, 0) for x in no]
    kinds = [x & 7 for x in look]
    level = [x >> LEVEL & 7 for x in look]
    bullet = [bool(x & BULLET) for x in look]
    links = [bool(f & LINKS) and k == SHORT for f, k in zip(flags, kinds)]
    lone = [bool(f & ONE_LINK) and k == FACT for f, k in zip(flags, kinds)]
    is_tpl = [bool(f & TEMPLATE) and v < 2 for f, v in zip(flags, level)]
    title = None
    paths: dict[int, list[int]] = {}
    for k, j in zip(crumbs[::2], crumbs[1::2]):
        paths.setdefault(k, [])
        if j >= 0:
            paths[k].append(j)
    for k, same in paths.items():
        if same:
            plain = [j for j in same if not bullet[j]]
            title = next((j for j in plain if j + 1 < n and not links[j + 1] and kinds[j + 1] in (PARA, FACT, ITEM)), (plain or same)[0])
        if title is not None or not is_tpl[k]:
            break
    if title is None:
        title = next((k for k in range(n) if level[k] == 1), None)
    if title is None:
        first = next((k for k in range(n) if kinds[k] in (PARA, FACT) and not is_tpl[k] and not lone[k]), None)
        if first is not None:
            title = next((k for k in range(first - 1, -1, -1) if kinds[k] == SHORT and not is_tpl[k] and not links[k]), first)
    if title is None:
        title = next((k for k in range(n) if kinds[k] == SHORT and not is_tpl[k] and not links[k]), n)
    out = set(range(title))
    k = title + 1
    while k < n:
        if links[k]:
            out.add(k)
            k += 1
            bullets = None
            while k < n and not is_tpl[k] and not links[k]:
                if level[k] or kinds[k] in (PARA, FACT, SEP, CRUMB):
                    break
                if bullets is None:
                    bullets = bullet[k]
                elif bullets != bullet[k]:
                    break
                if kinds[k] == SHORT and flags[k] & HEAD and k + 1 < n and kinds[k + 1] in (PARA, FACT, ITEM) and not is_tpl[k + 1]:
                    break
                out.add(k)
                k += 1
            continue
        if is_tpl[k] or kinds[k] in (SEP, LINK, CRUMB, CUT) or lone[k]:
            out.add(k)
        k += 1
    # behind the last body line, what follows the first template line is the foot of the page; captions may stand there, too
    last = max((j for j in range(n) if kinds[j] in (PARA, FACT, ITEM) and j not in out), default=title)
    foot = False
    for j in range(last + 1, n):
        if j in out:
            foot = True
        elif foot and kinds[j] == SHORT and not look[j] & CAPTION:
            out.add(j)
    return [no[j] for j in sorted(out)]


_READ = "site bigint, no array<int>, look array<int>, h1 array<bigint>, h2 array<bigint>, rep array<int>, exact array<bigint>, near array<int>, crumbs array<int>"


def _pages(cache: DataFrame) -> DataFrame:
    """(cache_id, value, vh, vl): the entries of namespace page with a value, and a hash and the length of it."""
    return cache.where("namespace = 'page' and trim(value) <> ''").select("cache_id", "value", F.xxhash64("value").alias("vh"), F.length("value").alias("vl"))


def read_pages(cache: DataFrame) -> DataFrame:
    """(page, vh, vl, real, site, no, look, h1, h2, rep, exact, near, crumbs): each value once, see read_page(). A page that nothing tells the site of is a site of its own, and real is false. A table in the shared folder."""
    pages = _pages(cache)
    texts = pages.groupBy("vh", "vl").agg(F.min("cache_id").alias("page"))

    @F.pandas_udf(_READ)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple] = {}
        for s in batches:
            rows = list(zip(*[read_page(x, memo) for x in s]))
            yield pd.DataFrame(dict(zip(("site", "no", "look", "h1", "h2", "rep", "exact", "near", "crumbs"), [pd.Series(rows[0], dtype="Int64"), *map(list, rows[1:])]))) if rows else pd.DataFrame()

    one = spread(pages).join(texts.select("page"), F.col("cache_id") == F.col("page"), "left_semi").withColumn("r", read("value"))
    one = one.select(F.col("cache_id").alias("page"), "vh", "vl", F.col("r.site").isNotNull().alias("real"), F.coalesce("r.site", F.xxhash64("cache_id", F.lit(1))).alias("site"), *[f"r.{c}" for c in ("no", "look", "h1", "h2", "rep", "exact", "near", "crumbs")])
    return materialize(one, "pages")


def site_tokens(one: DataFrame) -> DataFrame:
    """(site, real, h1, h2, support, occurs, v1, v2, fixed, body, sentence, heading, apart): what is known of each token of a site, and under h1 = h2 = 0 its number of pages. v1 and v2 are the occurrence vector, as two order-free fingerprints of the pages and the counts in them, so that no list of a site's pages is ever held. A table in the shared folder."""
    line = one.select("site", "real", "page", F.inline(F.arrays_zip("look", "h1", "h2", "rep", "exact", "near")))
    line = line.unionByName(one.select("site", "real", "page", *[F.lit(0).alias(c) for c in ("look", "h1", "h2", "rep", "exact", "near")]))
    kind = F.col("look").bitwiseAND(7)
    return materialize(
        line.groupBy("site", "real", "h1", "h2").agg(
            F.count_if(F.col("rep") == 0).alias("support"),
            F.count("*").alias("occurs"),
            F.bit_xor(F.xxhash64("page", "rep")).alias("v1"),
            F.bit_xor(F.xxhash64("rep", "page")).alias("v2"),
            (F.min("exact") == F.max("exact")).alias("fixed"),
            F.bool_or(kind.isin(FACT, ITEM)).alias("body"),
            F.bool_or(kind == PARA).alias("sentence"),
            F.count_if(F.col("near") >= 32).alias("heading"),
            F.count_if((kind == FACT) & (F.col("near") > 0)).alias("apart"),
        ),
        "tokens",
    )


def site_templates(one: DataFrame, tokens: DataFrame, least_pages: int = 8, site_share: float = 0.3, least_tokens: int = 3) -> DataFrame:
    """(site, pages, class, support, tokens, level, inside, gap, members): the valid classes of each site of least_pages pages or more; members are their tokens (h1, h2, plain).

    A class holds the tokens of one occurrence vector that cover site_share of the pages; so a site has at most the mean
    number of its pages' tokens / site_share valid ones, and its classes are a short list. level: it has least_tokens
    tokens or stands on every page. inside is the smallest level that all pages of another class hold with the class in
    one and the same gap between its tokens, and gap is that gap; null for what is nested in none. plain members have no
    varying numbers and are neither facts nor items. A table in the shared folder.
    """
    sites = tokens.where("real and h1 = 0 and h2 = 0").select("site", F.col("support").alias("pages")).where(F.col("pages") >= least_pages)
    valid = tokens.where("h1 <> 0 or h2 <> 0").join(sites, "site").where(F.expr(f"support >= {site_share} * pages"))
    member = F.struct("h1", "h2", F.expr("fixed and not body").alias("plain"))
    classes = valid.groupBy("site", "pages", "support", "v1", "v2").agg(F.sort_array(F.collect_list(member)).alias("members"))
    classes = classes.select("site", "pages", "support", F.xxhash64("v1", "v2", "support").alias("class"), F.size("members").alias("tokens"), "members")
    classes = materialize(classes.withColumn("level", F.expr(f"tokens >= {least_tokens} or support = pages")), "classes")
    # each page tells which of its classes stand in which gap of its levels
    by_site = classes.groupBy("site").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct(m["h1"].alias("h1"), F.struct("class", "level").alias("c"))))).alias("m"))
    found = one.where("real").join(by_site.select("site", F.map_from_entries("m").alias("m")), "site")
    hits = F.filter(F.transform(F.arrays_zip("h1", "rep"), lambda x, k: F.struct(k.alias("k"), F.when(x["rep"] == 0, F.element_at("m", x["h1"])).alias("c"))), lambda x: x["c"].isNotNull())
    found = found.select("site", hits.alias("hits"))
    levels = F.array_distinct(F.transform(F.filter("hits", lambda x: x["c"]["level"]), lambda x: x["c"]["class"]))
    first = F.filter("hits", lambda x, k: ~F.exists(F.slice("hits", F.lit(1), k), lambda y: y["c"]["class"] == x["c"]["class"]))
    gap = lambda x, b: F.size(F.filter("hits", lambda y: (y["c"]["class"] == b) & (y["k"] < x["k"])))
    pairs = F.flatten(F.transform(first, lambda x: F.transform(F.filter(levels, lambda b: b != x["c"]["class"]), lambda b: F.struct(x["c"]["class"].alias("class"), b.alias("inside"), gap(x, b).alias("gap")))))
    met = found.select("site", F.explode(pairs).alias("p")).groupBy("site", "p.class", "p.inside").agg(F.count("*").alias("n"), F.min("p.gap").alias("gap"), F.max("p.gap").alias("last"))
    outer = classes.where("level").select("site", F.col("class").alias("inside"), F.col("support").alias("held"))
    nested = met.join(classes.select("site", "class", "support"), ["site", "class"]).join(outer, ["site", "inside"]).where("n = support and gap = last and held > support")
    nested = nested.groupBy("site", "class").agg(F.min(F.struct("held", "inside", "gap")).alias("o")).select("site", "class", "o.inside", "o.gap")
    out = materialize(classes.join(nested, ["site", "class"], "left").select("site", "pages", "class", "support", "tokens", "level", "inside", "gap", "members"), "templates")
    drop_materialized(out.sparkSession, classes)
    return out


def known_tokens(one: DataFrame, tokens: DataFrame, templates: DataFrame, least_pages: int, site_share: float, form_share: float, least_tokens: int) -> DataFrame:
    """(site, h1, h2, occurs, flags) of each token of each site of which something is known. A table in the shared folder."""
    real = tokens.where("h1 <> 0 or h2 <> 0")
    sites = tokens.where("real and h1 = 0 and h2 = 0").select("site", F.col("support").alias("pages")).where(F.col("pages") >= least_pages)
    # forms that are valid wherever they are met, and stand on most pages of some site
    on_site = real.join(sites, "site").groupBy("site", "h2").agg(F.max(F.expr(f"support >= {site_share} * pages")).alias("valid"), F.max(F.col("support") / F.col("pages")).alias("share"))
    voted = on_site.groupBy("h2").agg(F.avg(F.col("valid").cast("double")).alias("ratio"), F.max("share").alias("share")).where((F.col("ratio") >= form_share) & (F.col("share") >= form_share)).select("h2")
    # a sentence met again and again on one site and nowhere else speaks for the site, and its form for any, once several sites have it so
    own = real.groupBy("h1").agg(F.count_if("real").alias("n"), F.max(F.struct(F.col("real").alias("r"), "site", "support", "h2")).alias("t"), F.bool_or("sentence").alias("sentence"))
    own = materialize(own.where("n = 1 and sentence and t.support >= 5").select("h1", "t.site", "t.support", "t.h2").join(sites, "site").where("support >= 0.1 * pages"), "own")
    spoken = own.groupBy("h2").agg(F.countDistinct("site").alias("n")).where("n >= 3").select("h2")
    # roles of forms: what may head a part, what heads lists of links, what labels one link
    by_form = real.groupBy("h2").agg(F.sum("heading").alias("heading"), F.sum("apart").alias("apart"), F.sum("occurs").alias("n"))
    line = one.select(F.inline(F.arrays_zip("h2", "look", "near")))
    behind = line.where("(look & 7) in (%d, %d) and near %% 32 > 0" % (SHORT, FACT)).groupBy("h2", (F.col("near") % 32).alias("b")).agg(F.count("*").alias("c")).groupBy("h2").agg(F.sum("c").alias("short"), F.max("c").alias("most"))
    forms = by_form.join(behind, "h2", "left").withColumn("varied", F.expr("n >= 3 and most <= short * (0.25 + 1 / sqrt(short))"))
    forms = forms.select(
        "h2",
        F.expr("heading >= 3 and heading >= 0.3 * n").alias("head"),
        F.expr("heading >= 3 and heading >= 0.66 * n").alias("heading"),
        F.coalesce(F.expr("varied and apart = 0 and short >= 0.7 * n"), F.lit(False)).alias("links"),
        F.coalesce(F.expr("varied and apart >= 0.6 * n"), F.lit(False)).alias("lone"),
    )
    template = voted.unionByName(spoken).distinct().withColumn("tpl", F.lit(True))
    forms = materialize(forms.join(template, "h2", "left").where("head or heading or links or lone or tpl"), "forms")  # tables of known size, so that small ones are broadcast and the tokens stay where they are
    # the site's own template: its levels, and what is nested in them and no slot by its looks
    here = templates.select("site", F.expr("level and tokens >= %d" % least_tokens).alias("large"), F.expr("level or inside is not null").alias("held"), F.explode("members").alias("m"))
    here = here.where("large or held and m.plain").select("site", "m.h1", "m.h2", "large")
    known = real.select("site", "h1", "h2", "occurs").join(forms, "h2", "left").join(own.select("h1", F.lit(True).alias("own")), "h1", "left").join(here, ["site", "h1", "h2"], "left")
    tpl = F.expr("coalesce(tpl, false) or coalesce(own, false) or (large is not null and (large or not coalesce(heading, false)))")
    bit = lambda c, b: F.when(c, b).otherwise(0)
    flags = bit(tpl, TEMPLATE) + bit(F.col("head"), HEAD) + bit(F.col("links"), LINKS) + bit(F.col("lone"), ONE_LINK)
    known = materialize(known.select("site", "h1", "h2", "occurs", flags.alias("flags")).where("flags > 0"), "known")
    for t in (own, forms):
        drop_materialized(t.sparkSession, t)
    return known


def boilerplate_lines(cache: DataFrame, least_pages: int = 8, site_share: float = 0.3, form_share: float = 0.5, least_tokens: int = 3) -> DataFrame:
    """(cache_id, line_no) of each non-blank line of an entry of namespace page that isn't main body.

    The template of a site of least_pages pages or more is deduced from its classes (see site_templates()): levels of
    least_tokens tokens or more with all their tokens; other levels and nested classes without what looks like a slot. For
    what is seen too seldom on its own site, a form (the token without its names) is template if it is valid on form_share
    of the well-covered sites that have it, and stands on form_share of one's pages. Entries with one value are read once and give their lines to each cache_id.
    Null, empty and blank values and other namespaces give no lines; pages without a title keep all that no rule takes
    away. An empty table gives none.
    """
    one = read_pages(cache)
    tokens = site_tokens(one)
    templates = site_templates(one, tokens, least_pages, site_share, least_tokens)
    known = known_tokens(one, tokens, templates, least_pages, site_share, form_share, least_tokens)
    for t in (tokens, templates):
        drop_materialized(one.sparkSession, t)
    # tokens of more than a 20,000th of all lines, 20,000 at most, are broadcast; the others meet their lines by a join without hot keys
    lines = one.agg(F.sum(F.size("no"))).first()[0] or 0
    hot = F.col("occurs") > lines / 20_000
    line = one.select("page", "site", F.inline(F.arrays_zip("no", "h1", "h2")))
    key = ["site", "h1", "h2"]
    line = line.join(F.broadcast(known.where(hot).select(*key, F.col("flags").alias("hot"))), key, "left")
    cold = line.where("hot is null").drop("hot").join(known.where(~hot).select(*key, "flags"), key).select("page", "no", "flags")
    flagged = line.where("hot is not null").select("page", "no", F.col("hot").alias("flags")).unionByName(cold)
    by_page = flagged.groupBy("page").agg(F.collect_list(F.col("no") * 16 + F.col("flags")).alias("known"))

    @F.pandas_udf("array<int>")
    def decide(no: pd.Series, look: pd.Series, known: pd.Series, crumbs: pd.Series) -> pd.Series:
        tell = lambda f: {} if f is None else {x >> 4: x & 15 for x in f.tolist()}
        return pd.Series([main_lines(n.tolist(), v.tolist(), tell(f), c.tolist()) for n, v, f, c in zip(no, look, known, crumbs)], dtype=object)

    cut = one.select("page", "vh", "vl", "no", "look", "crumbs").join(by_page, "page", "left").select("vh", "vl", decide("no", "look", "known", "crumbs").alias("out"))
    return _pages(cache).select("cache_id", "vh", "vl").join(cut, ["vh", "vl"]).select("cache_id", F.explode("out").alias("line_no")).withColumn("line_no", F.col("line_no").cast("bigint"))


def main_body(cache: DataFrame) -> DataFrame:
    """(cache_id, body) of each entry of namespace page: its lines without boilerplate and blank lines. A null or empty value has a null body."""
    pages = cache.where("namespace = 'page'").select("cache_id", "value")
    out = boilerplate_lines(cache).groupBy("cache_id").agg(F.collect_list("line_no").alias("out"))
    lines = F.split("value", "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).cast("bigint").alias("no"))), lambda s: (F.trim(s["x"]) != "") & ~F.array_contains(F.coalesce("out", F.array().cast("array<bigint>")), s["no"]))
    body = F.when(F.col("value").rlike(r"\S"), F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return pages.join(out, "cache_id", "left").select("cache_id", body.alias("body"))


def template_report(cache: DataFrame, least_pages: int = 8, site_share: float = 0.3, least_tokens: int = 3) -> DataFrame:
    """(site, pages, class, support, tokens, level, inside, gap): the deduced template of each well-covered site, without its tokens."""
    one = read_pages(cache)
    return site_templates(one, site_tokens(one), least_pages, site_share, least_tokens).drop("members")
