import random

from loomtrail.llm import boilerplate as B

SCHEMA = "cache_id bigint, namespace string, cache_key string, value string, page bigint, lines int, site int"


MATERIALS = ["oak", "clay", "zinc", "brick", "slate", "glass"]


def page(r, site, k, related=True):
    nav = ["Home", "Events", "Shop", "Help"] if site else ["Map", "Jobs", "Visit", "News"]
    name = ["Kofell Herald", "Zolfell Guide"][site]
    body = [(f"Title {k} Tower", 1)]
    for j in range(r.randint(1, 3)):
        if j:
            body.append((r.choice(["History", "Events", "Location", "Sources", "Later use", "Construction"]), 1))
        body.append((f"The {r.choice(['old', 'low', 'tall'])} {r.choice(['gate', 'roof', 'wall', 'mill'])} of {r.choice(['Ana', 'Otto', 'Ida'])} lost {r.randint(1, 999)} stones in {r.randint(1700, 1999)}.", 1))
        if r.random() < 0.5:
            body += [(f"Height: {r.randint(1, 99)}", 1), (f"Material: {r.choice(MATERIALS)}", 1)]
        if r.random() < 0.5:
            body += [(f"- Kofell, {r.randint(1700, 1999)}", 1), (f"• Nurford, {r.randint(1700, 1999)}", 1)]
        if r.random() < 0.6:
            body.append(("Advertisement", 0))
    if related and r.random() < 0.5:
        body += [("Also of interest", 0), (f"Lake {k}", 0), ("The old roof was ...", 0)]
    top = [(n, 0) for n in nav] + [(f"Home / {nav[1]} / Title {k} Tower", 0)]
    foot = [(f"{name} collects notes on mills. It was started in 1900.", 0), ("Back to top", 0), (f"Last build {r.randint(2000, 2020)}-01-02", 0), (f"© {r.randint(2000, 2020)} {name}. All rights reserved.", 0)]
    lines = top + body + foot
    out = []
    for x in lines:
        out.append(x)
        if r.random() < 0.1:
            out.append(("", None))
    return out


def test_sites(spark):
    r = random.Random(3)
    made = {k: page(r, k % 2, k) for k in range(120)}
    rows = [(k, "page", f"k{k}", "\n".join(x for x, _ in p), 0, 0, 0) for k, p in made.items()]
    rows += [(500, "page", "k1", rows[0][3], 0, 0, 0), (501, "page", "z", None, 0, 0, 0), (502, "page", "y", " \n ", 0, 0, 0), (503, "caption", "c", "Home\nBack to top", 0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for x in B.boilerplate_lines(df).collect():
        got.setdefault(x["cache_id"], set()).add(x["line_no"])
    right = wrong = missed = 0
    for k, p in made.items():
        want = {n for n, (_, b) in enumerate(p, 1) if b == 0}
        right += len(want & got[k])
        wrong += len(got[k] - want)
        missed += len(want - got[k])
    assert right / (right + wrong) > 0.99 and right / (right + missed) > 0.99
    assert got[500] == got[0] and not {501, 502, 503} & set(got)
    bodies = {x["cache_id"]: x["body"] for x in B.main_body(df).collect()}
    assert bodies[501] is None and bodies[502] is None and 503 not in bodies and bodies[500] == bodies[0] and "Back to top" not in bodies[0]
    t = B.template_report(df).collect()
    assert len({x["site"] for x in t}) == 2 and max(x["tokens"] for x in t) >= 4
    assert all(x["inside"] is None or any(o["class"] == x["inside"] and o["level"] and o["support"] > x["support"] and o["site"] == x["site"] for o in t) for x in t)
    assert B.boilerplate_lines(df.limit(0)).count() == 0


def test_page_seen_once(spark):
    text = "# Lake Pir\nThe lake is 20 metres deep and was drained in 1900.\n## History\nIt was first named in a letter of 1700.\nFig. 2. The lake near Kofell"
    df = spark.createDataFrame([(1, "page", "k", text, 0, 0, 0), (2, "page", "l", "x" * 200_000, 0, 0, 0)], SCHEMA)
    assert B.boilerplate_lines(df).count() == 0


def site_pages(extra, count=20):
    """Pages of one site; extra(k) are lines between the two paragraphs of page k."""
    rows = []
    for k in range(count):
        words = ["gate", "roof", "wall", "mill", "dock"]
        top = ["Map", "Jobs", "Visit", "News", f"# Tower {chr(65 + k)} {words[k % 5]}", f"The old {words[k % 5]} of {chr(65 + k)} was built by the {words[k // 5]} guild."]
        lines = [*top, *extra(k), f"A {words[k // 5]} stands near {chr(65 + k)} since the {words[k % 5]} fell.", "Back to top"]
        rows.append((k, "page", f"k{k}", "\n".join(lines), 0, 0, 0))
    return rows


def out_lines(spark, rows):
    """The set of texts that are taken away on any page."""
    text = {r[0]: r[3].split("\n") for r in rows}
    return {text[x["cache_id"]][x["line_no"] - 1] for x in B.boilerplate_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_large_class_is_template_on_its_site(spark):
    """Three lines that stand on the same 8 of 20 pages are a class; their forms alone, at 40 %, win no vote."""
    box = ["Get our letter", "Your address here", "Send it weekly"]
    got = out_lines(spark, site_pages(lambda k: box if k % 5 < 2 else []))
    assert set(box) <= got and not any(x.startswith(("#", "The old", "A ")) for x in got)


def test_small_class_is_template_on_its_site(spark):
    """A line alone in its class, on 8 of 20 pages, is an option of the site's template; a heading, a fact or a numbered line isn't."""

    def extra(k):
        lines = ["Enter your address to subscribe", "- Kofell, 17"] if k % 5 < 2 else []
        lines += ["History", f"The dock of {chr(65 + k)} kept a key of {chr(75 + k)}."] if k % 5 in (1, 2) else []
        return lines + ([f"Route {k} north", "Material: oak"] if k % 5 in (2, 3) else [])

    got = out_lines(spark, site_pages(extra))
    assert "Enter your address to subscribe" in got
    assert not any(x.startswith(("History", "Material", "Route", "The dock", "- Kofell", "#", "The old", "A ")) for x in got)


def test_classes_come_from_the_occurrence_vectors(spark):
    """Two boxes of equal support on different pages are two classes; on the same pages they are one."""

    def tokens_of(extra):
        rows = spark.createDataFrame(site_pages(extra), SCHEMA)
        return {(x["support"], x["tokens"]) for x in B.template_report(rows).collect()}

    assert (10, 4) in tokens_of(lambda k: ["One a", "One b", "Two a", "Two b"] if k % 2 else [])
    apart = tokens_of(lambda k: ["One a", "One b"] if k % 2 else ["Two a", "Two b"])
    assert (10, 2) in apart and (10, 4) not in apart
    twice = tokens_of(lambda k: (["One a", "One a", "One b", "Two a", "Two b"] if k % 4 == 1 else ["One a", "One b", "Two a", "Two b"]) if k % 2 else [])
    assert (10, 1) in twice and (10, 3) in twice


def test_a_class_is_nested_by_pages_and_place(spark):
    """An option that always stands in one gap of the site's template is nested in it; one that stands now before, now behind a level's token isn't."""
    got = {x["support"]: x for x in B.template_report(spark.createDataFrame(site_pages(lambda k: ["Enter your address"] if k % 5 < 2 else []), SCHEMA)).collect()}
    assert got[20]["level"] and got[8]["inside"] == got[20]["class"] and got[8]["gap"] == 4
    rows = site_pages(lambda k: [])
    rows = [(*r[:3], r[3].replace("Back to top", "Back to top\nRate it" if r[0] % 2 else "Rate it\nBack to top") if r[0] % 4 < 2 else r[3], *r[4:]) for r in rows]
    moved = {x["support"]: x for x in B.template_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert moved[10]["inside"] is None


def test_navigation_after_many_lines(spark):
    """A menu behind forty lines of a page tells its site all the same."""
    lead = "\n".join(f"The {a}{b} of the old mill was kept by the guild." for a in "abcde" for b in "fghijklm")
    got = B.read_page(lead + "\nMap\nJobs\nVisit\n# Old Tower")
    assert got[0] == B.read_page("Jobs\nMap\nVisit\n# Big Lake")[0] is not None


def test_lists_of_links_are_learned(spark):
    """A heading behind which ever other short lines stand, in words that no list names, takes its lines with it; a heading of parts doesn't."""
    r = random.Random(9)
    rows = []
    for k in range(60):
        name = lambda: f"{r.choice('ABCDEFGH')}{r.choice('aeiou')}l{r.choice('mnrst')}{r.choice('aeiou')} Mill"
        links = ["Onward to"] + [name() for _ in range(3)]
        rows.append((k, "page", f"k{k}", "\n".join([f"# {name()} {k}", f"The mill of {name()} was built in {1700 + k} by its owner.", "History", f"It was sold to {name()} in {1800 + k}.", *links]), 0, 0, 0))
    got = {(x["cache_id"], x["line_no"]) for x in B.boilerplate_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(k, n) for k in range(60) for n in (5, 6, 7, 8)}
