import random
import re

import duckdb
import pytest

from bandweave.llm import licenses, pii, quality, queries, toxicity
from bandweave.llm.shingles import ALPHANUMERIC, hashed_words, shingled

WORD = re.compile("[^\x20\x09-\x0D]+")


def counted(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    held = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(held)


def test_quality_features(docs):
    rng = random.Random(1)
    texts = [None, "", " \x0b\x0c\r\t", "a\xa0b ñ\x1cx", "l\nl\n l\nl\n\n", "one two three four five six " * 3, "fff\fg"]
    texts += [" ".join(rng.choice("ab#") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["\n".join(rng.choice(["x y", "z", " ", ""]) for _ in range(9)) for _ in range(20)]
    rows = quality.features(docs(texts, source=["s"] * len(texts), n_words=["clash"] * len(texts))).collect()
    for r in rows:
        c = counted(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c
        assert r["base_failed"] == (c[0] < 10 or 100 * c[4] > 20 * c[0])


def test_hosts(docs):
    good, bad = "these are ten words that make up one fine line", "too short"
    texts = [good] * 30 + [bad] * 25 + [good] * 5 + [bad, good] + [good, None]
    hosts = ["good"] * 30 + ["bad"] * 30 + ["tiny"] * 2 + [None] * 2
    rows = quality.features(docs(texts, source=hosts))
    verdicts = {r["host"]: r for r in quality.host_verdicts(rows).collect()}
    assert {h: r["host_failed"] for h, r in verdicts.items()} == {"good": False, "bad": True, "tiny": False}
    assert 25 / 31 < verdicts["bad"]["rate_short"] < 25 / 30 and verdicts["good"]["rate_short"] > 0
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(rows, quality.host_verdicts(rows)).collect()}
    assert len(kept) == 64 and sum(kept.values()) == 30 + 1 + 1 and not kept[56] and kept[62] and not kept[63]
    empty = quality.features(docs(["x"], source=["s"]).limit(0))
    assert quality.judged(empty, quality.host_verdicts(empty)).isEmpty()


@pytest.mark.parametrize("others", [40, 4000])
def test_a_host_is_judged_alike_beside_any_number_of_documents(spark, others):
    rows = spark.range(10 + others).selectExpr("if(id < 10, 'bad', 'other') as source", "if(id < 10 or id % 10 = 0, 5L, 20L) as n_words", "0L as n_repeat_words", "0L as n_symbols", "80L as word_chars", "0L as n_dup_lines", "1L as n_lines")
    assert {r["host"]: r["host_failed"] for r in quality.host_verdicts(rows).collect()} == {"bad": True, "other": False}


def test_quality_is_native(docs):
    rows = quality.features(docs(["a"], source=["s"]))
    plan = quality.judged(rows, quality.host_verdicts(rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", ["op3_warc", "op4_quality"])
def test_against_sql(spark, sf, name, tmp_path):
    queries.QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    con.execute(f"create table a as select * from '{tmp_path}/out/*.parquet'")
    con.execute(f"create table b as {queries.ORACLE[name]}")
    columns = ", ".join(sorted(c[0] for c in con.execute("select column_name from (describe a)").fetchall()))
    for x, y in (("a", "b"), ("b", "a")):
        assert con.execute(f"select {columns} from {x} except all select {columns} from {y} limit 3").fetchall() == []


def base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(int(c) * 2))) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_plain_identifiers():
    rng = random.Random(5)
    parts = ["a", "@", "@.", "b.c", ".", "1", "23", "192.168.0.1", " ", "-", "+1", "4111111111111111", "(", "é", "999", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sorted(base(text)) == sorted(pii.plain(text))
        assert sorted(base(text)) == sorted(s[:3] for s in pii.spans(text) if s[3])


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("john dot doe at example dot com.", "email", "john dot doe at example dot com"),
        ("to jane(at)mail.example.org, ok", "email", "jane(at)mail.example.org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("a​b@ex​ample.com", "email", "a​b@ex​ample.com"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("four" + " one" * 15, "card", "four" + " one" * 15),
        ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
        ("+４９ ３０ １２３４５６７", "phone", "+４９ ３０ １２３４５６７"),
        ("null" + " eins" * 0 + " drei vier", None, None),
        ("look at this dot and that", None, None),
        ("we met at noon at example.com", None, None),
        ("jane @ example.com, she said", "email", "jane @ example.com"),
        ("meet @ noon. Then", None, None),
        ("john     at     example dot com", "email", "john     at     example dot com"),
        ("a" * 100 + " [at] example.com", "email", "a" * 100 + " [at] example.com"),
        ("a.b.c.d.e.f.g at x dot y dot z dot a dot b dot c dot d dot e dot f dot com", "email", "a.b.c.d.e.f.g at x dot y dot z dot a dot b dot c dot d dot e dot f dot com"),
    ],
)
def test_disguises(text, kind, found):
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)] == ([(kind, found)] if kind else [])
    if kind:
        assert pii.redacted(f"{text}") == text.replace(found, f"[{kind.upper()}]")


def test_planted_disguises():
    """Texts put together of prose and disguised identifiers: each span is where the identifier was put, no other is found."""
    rng = random.Random(9)
    blanks = lambda least: rng.choice([" ", "  ", "\n", "\t ", " " * 9]) if least or rng.random() < 0.5 else ""
    name = lambda: "".join(rng.choices("bcdfgxyz", k=rng.choice([1, 3, 8, 90])))
    bracketed = lambda words: f"{blanks(0)}{rng.choice('[({<')}{blanks(0)}{rng.choice(words)}{blanks(0)}{rng.choice('])}>')}{blanks(0)}"
    spelled = lambda words: f"{blanks(1)}{rng.choice(words)}{blanks(1)}"
    greek = str.maketrans({"o": "ο", "a": "а", "e": "е"})
    digits = pii.DIGIT_NAMES["en"].split()

    def email():
        dots = ["dot", "DOT", "punto"]
        dot = lambda: rng.choice([".", bracketed([*dots, "."]), spelled(dots)])
        local = name() + "".join(dot() + name() for _ in range(rng.randint(0, 7)))
        host = name() + "".join(dot() + name() for _ in range(rng.randint(0, 9)))
        kind = rng.randrange(3)
        at = bracketed(["at", "@", "arroba"]) if kind == 0 else spelled(["at", "AT"]) if kind == 1 else rng.choice(["", " ", "   "]) + "@" + rng.choice(["", " ", "   "])
        return local + at + host + (spelled(dots) if kind == 1 else dot()) + rng.choice(["com", "org", "de"])

    for _ in range(600):
        text, want = "", []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(["prose; ", "the end, ", "(so) ", "look there: "])
            kind = rng.choice(["email", "phone", "none"])
            made = email() if kind == "email" else "plus " + rng.choice([" ", ", ", "-", "   "]).join(rng.choices(digits, k=rng.randint(9, 11))) if kind == "phone" else "Мοscow"
            if kind == "email" and rng.random() < 0.3:
                made = made.translate(greek) if "[" not in made and "punto" not in made else made
            if kind != "none":
                want.append((kind, made))
            text += made + "; "
        got = [(k, text[a:b], is_base) for k, a, b, is_base in pii.spans(text)]  # a part of an address may be one as it stands
        assert [x[:2] for x in got if x[:2] in want] == want and all(x[2] or x[:2] in want for x in got), text


def test_long_texts_are_read_in_linear_time():
    import time

    began = time.perf_counter()
    for text, least in (("1" * 1_000_000 + ".", 0), ("1." * 500_000, 0), ("a@b.cd 10.0.0.1 " * 100_000 + "x [at] y [dot] com", 200_001), (" " * 1_000_000 + "[at]", 0), ("[ " * 300_000, 0), ("a dot " * 200_000 + "at", 0), ("one " * 300_000, 0), ("x at y dot " * 100_000, 0), ("@ " * 300_000, 0), ("1" * 300_000 + "а", 0)):
        assert len(pii.spans(text)) >= least
    assert time.perf_counter() - began < 60


def test_pii_frames(docs):
    texts = [None, "", "a@b.cd +1 234 567 8901", "x" * 100_000 + " a@b.cd", "same a@b.cd", "same a@b.cd"]
    rows = {r["doc_id"]: r for r in pii.find(docs(texts, pii=["clash"] * 6)).collect()}
    assert [len(rows[k]["pii"]) for k in range(6)] == [0, 0, 2, 1, 1, 1]
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs(texts)).collect()}
    assert redacted[2] == "[EMAIL] [PHONE]" and redacted[0] is None and redacted[1] == ""
    assert pii.find(docs(texts).limit(0)).isEmpty()


def test_further_columns_of_any_name_stay(docs):
    names = ["_text", "_words", "_lines", "_windows", "text_", "Words_", "lines_", "windows_", "_salt", "salt", "of", "known", "bad", "_host", "_bad"]
    df = docs(["one two three four five six seven eight nine ten", None], source=["a", None], **{n: [n, None] for n in names})
    rows = quality.features(df)
    made = quality.judged(rows, quality.host_verdicts(rows))
    assert made.columns[: len(df.columns)] == df.columns
    first = made.where("doc_id = 0").first()
    assert [first[n] for n in names] == names and first["kept"] and first["n_words"] == 10


def test_toxicity(docs, spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioubcdfg", k=4)) for _ in range(400)]

    def text(bad):
        made = rng.choices(words, k=rng.randint(5, 60))
        for _ in range(3 * bad):
            made.insert(rng.randint(0, len(made)), rng.choice(["Scoundrel,", "vermin"]))
        return " ".join(made)

    labels = [rng.random() < 0.2 for _ in range(1200)]
    texts = [*map(text, labels), None, "", "x " * 30_000]
    df = docs(texts, score=["clash"] * len(texts))
    truth = spark.createDataFrame([*enumerate(map(int, labels)), (5000, 1), (3, None)], "doc_id bigint, toxic int")
    rows = toxicity.score(df, toxicity.fit(df, truth)).withColumn("held_out", toxicity.fold() == 0).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 1200]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.97
    assert toxicity.score(df.limit(0), toxicity.fit(df, truth)).isEmpty()
    assert toxicity.score(df, toxicity.fit(df, truth.limit(0))).count() == len(texts)


def test_licenses():
    template, rng = licenses.prepared(tuple(licenses.TEMPLATES.items())), random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=5)) for _ in range(300)]
    texts, truth = [], []
    for k in range(300):
        before, after = (" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(2))
        name, notice = rng.choice([*licenses.TEMPLATES.items()])
        cut = notice.split()
        if len(cut) > 30 and k % 3 == 0:
            cut[rng.randint(10, 20)] = "other"
        texts.append(f"{before} {' '.join(cut).upper() if k % 2 else ' '.join(cut)} {after}")
        truth.append(name)
    got = template.scan([*texts, None, "", "a b"])
    assert all(truth[k] in {n for j, n, *_ in got if j == k} for k in range(300))
    # exact: of every window that holds enough of a template, whatever the bands say
    hashed, bounds, _, _ = hashed_words(texts, ALPHANUMERIC)
    missed = 0
    found = {(k, n) for k, n, *_ in got}
    for k in range(300):
        shingles = shingled(hashed[bounds[k] : bounds[k + 1]], 5)
        for block, ts in template.levels.items():
            for t in ts:
                if any(template.verified(shingles, block, w, t) for w in range(len(template.windows(len(shingles), block)))):
                    missed += (k, template.names[t]) not in found
    assert missed == 0 and len(found) < 700


def test_license_frames(docs):
    text = "été — Released under the MIT License. x"
    rows = licenses.scan(docs([text, None, "", text], license=["c"] * 4)).collect()
    assert {r["doc_id"] for r in rows} == {0, 3}
    assert {text[r["start"] : r["end"]] for r in rows} == {"Released under the MIT License"}
