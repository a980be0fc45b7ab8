import hashlib

import pytest

from bandweave.llm import warc, wrapper

LONG = "é" * 600


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, offset string").repartition(3)

    return make


def test_round_trip(pages):
    rows = [(1, "http://a/1", LONG), (2, None, LONG), (7, "http://a/\n x", LONG), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "n", LONG), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 100)]
    index = warc.write(pages(rows))
    assert index.count() == len(rows) and index.where("length > 0").count() == len(rows)
    back = {(r["page_id"], r["record_type"]): r for r in warc.read(index).collect()}
    assert len(back) == len(rows)
    for page_id, _, html in rows:
        again = page_id in (1, 2, None)
        r = back[(page_id, "revisit" if again else "response")]
        raw = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), 7 if again else None)
        assert r["payload"] == (None if again else html or "")
    whole = warc.resolved(warc.read(index)).collect()
    assert sorted((r["payload"] or "") for r in whole) == sorted(h or "" for _, _, h in rows)
    assert warc.read(index.where("page_id in (3, 8)")).count() == 2
    assert warc.write(pages(rows).limit(0)).isEmpty()


def test_repeated_rows_and_limit(pages):
    rows = [(1, "u", LONG)] * 3 + [(0, "u", LONG)]
    kinds = sorted((r["page_id"], r["record_type"]) for r in warc.read(warc.write(pages(rows))).collect())
    assert kinds == [(0, "revisit"), (1, "response"), (1, "response"), (1, "response")]
    at = [(1, "u", "a" * 999), (2, "u", "a" * 999), (3, "u", "a" * 1000), (4, "u", "a" * 1000)]
    assert {r["page_id"] for r in warc.planned(pages(at)).where("record_type = 'revisit'").collect()} == {3}


def test_coalescing():
    assert warc.coalesced([(0, 5), (5, 5), (200, 5), (206, 1)], gap=2, most=100) == [(0, 10, 2), (200, 207, 2)]
    assert warc.coalesced([(0, 60), (60, 60)], gap=2, most=100) == [(0, 60, 1), (60, 120, 1)]
    assert warc.coalesced([]) == []


def test_reading_tasks_follow_the_archives(pages, monkeypatch):
    import os

    rows = [(k, "u", os.urandom(3000).hex()) for k in range(40)]
    index = warc.write(pages(rows))
    monkeypatch.setattr(warc, "SPAN", 10_000)
    held = sum(r["length"] for r in index.collect())
    read = warc.read(index)
    assert read.rdd.getNumPartitions() >= held // 10_000 and {(r["page_id"], r["payload"]) for r in read.collect()} == {(k, h) for k, _, h in rows}


def test_broken_payload():
    row = {"page_id": 1, "url": "u", "html": "abc", "payload_bytes": 3, "payload_digest": hashlib.sha1(b"abd").hexdigest(), "record_type": "response", "refers_to": None}
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(warc.record(row))


def test_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>n</a></nav><script>var t="</p>";</script>
    <article><h1>Head &amp; tail</h1><p><b>One<br><p>Two&nbsp;  <i>it</i>alic, &#233;<ul><li>a<li>b</ul><div class="advert">buy</div><form>f</form></article>
    <section id="comments"><article><p>me too</p></article></section><aside>s</aside><footer>&copy;</footer>"""
    assert wrapper.extracted(page) == "Head & tail\nOne\nTwo italic, é\na\nb"
    assert wrapper.extracted(None) == wrapper.extracted("") == ""
    assert wrapper.extracted("<div><a href=x>home</a> <a>y</a></div><p>Some text &lt;b&gt;.</p> tail") == "Some text <b>.\ntail"
    assert wrapper.extracted("<div class=content><p>Main</div><div class='cookie-notice'>we use</div><div id=sideBar>x</div>") == "Main"
    assert wrapper.extracted("<article><p>cut &am") == "cut &am"
    assert wrapper.extracted("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == "deep\ner"


def matching(a, b, one, two, kids):
    """The textbook recursion: the size of the largest match of two trees."""
    if one[a][1] != two[b][1]:
        return 0
    x, y = kids[0][a], kids[1][b]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + matching(x[i - 1], y[j - 1], one, two, kids))
    return 1 + m[-1][-1]


def test_alignment_is_the_largest():
    import random

    rng = random.Random(4)

    def tree(depth=0):
        return "".join(f"<{t}>{tree(depth + 1) if depth < 3 else ''}x</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randint(0, 3)))

    for _ in range(60):
        one, two = wrapper.shape_of(tree()), wrapper.shape_of(tree())
        kids = wrapper.children_of(one), wrapper.children_of(two)
        pairs = wrapper.aligned(one, two)
        assert len(pairs) == matching(0, 0, one, two, kids) and len({a for a, _ in pairs}) == len(pairs)


def test_halved_tables_give_the_same(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(5)
    for _ in range(40):
        rows, columns = (np.array([rng.randrange(4) for _ in range(rng.randint(1, 14))]) for _ in range(2))
        weight = np.array([[rng.choice([0, 0, 1, 3]) for _ in range(4)] for _ in range(4)])
        total = lambda pairs: sum(weight[rows[i], columns[j]] for i, j in pairs)
        whole = wrapper.best_pairs(rows, columns, weight)
        with monkeypatch.context() as m:
            m.setattr(wrapper, "CELLS", 3)
            halved = wrapper.best_pairs(rows, columns, weight)
        for pairs in (whole, halved):
            assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:])) and total(pairs) == total(whole)


def test_template_of_a_host(pages):
    body = "<body><div><p>Our site, since 1990</p><p>{0} is what this page is about</p><p>Second {0}</p></div></body>"
    rows = [(k, f"https://www.A.example/{k}?q", body.format(f"Topic {k}")) for k in range(8)] + [(90, "https://b.example/", body.format("Other")), (91, None, body.format("None"))]
    rows += [(100 + k, "http://www.a.example/copy", body.format("Topic 1")) for k in range(20)]  # copies count once
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages(rows)).collect()}
    assert len(got) == len(rows) and got[3] == "Topic 3 is what this page is about\nSecond Topic 3" and got[105] == got[1]
    assert got[90].startswith("Our site") and got[91].startswith("Our site")
    assert wrapper.extract(pages(rows).limit(0)).isEmpty()


def words(rng, n):
    return " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau"], k=n))


def test_the_wrapper_is_found_by_structure(pages):
    """No element or name tells here what the article is; adverts, menus and last lines differ from page to page."""
    import random

    rng = random.Random(8)
    rows, want = [], {}
    for k in range(12):
        paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 9))]
        want[k] = "\n".join([f"Title {k}", *paragraphs])
        links = "".join(f"<li><a href=/{j}>{words(rng, 2)}</a></li>" for j in range(rng.randint(2, 6)))
        rows.append((k, "https://x.example/", f"<body><div class=q1><ul>{links}</ul></div><div class=q2>{words(rng, 6)}</div><div class=q3><h1>Title {k}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<p><a href=/>{words(rng, 3)}</a></p></div><div class=q4>{words(rng, 4)}</div></body>"))
    odd = "<body><div class=z><p>Another layout, once</p></div></body>"
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages([*rows, (50, "https://x.example/odd", odd)])).collect()}
    for k in want:
        assert got[k].startswith(want[k]) and got[k].count("\n") <= want[k].count("\n") + 1
    assert got[50] == "Another layout, once"
    alone = [wrapper.extracted(html) for _, _, html in rows]
    assert all(a != got[k] for k, a in enumerate(alone))


def test_parts_of_an_article_stay():
    page = "<article><p>One</p><section class='related-work'><p>Two</p></section><div class=discussion><p>Three <a href=/>x</a></p></div><div class=related><a href=/>more</a></div></article>"
    assert wrapper.extracted(page) == "One\nTwo\nThree x"


def test_deep_and_hostile_pages(pages):
    deep = ["<p>" + "<b>" * 6000 + "bold", "<div>" * 6000 + "in", "<a " * 20000, "<a x='" * 5001 + ">t", "</b>" * 50000 + "x", "<ul>" + "<li><p>q</p></li>" * 4000 + "</ul>", "<p " + "a" * 9000 + ">long attribute"]
    rows = [(k, "https://deep.example/", f"{d} {j}") for j in range(6) for k, d in [(10 * j + i, x) for i, x in enumerate(deep)]]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(pages([*rows, (99, "https://deep.example/", None)])).collect()}
    assert len(got) == len(rows) + 1 and got[99] == "" and got[56].startswith("long attribute")
    one, two = wrapper.shape_of("<div>" * 3000 + "x"), wrapper.shape_of("<div>" * 2999 + "<p>y")
    assert len(wrapper.aligned(one, two)) == 3000
