"""Operators 5, 7, 9 and 10, and the pipeline."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hydroframe.llm import html, langid, quality, secretscan, textkit


def test_rendering():
    page = """<!DOCTYPE html><html><head><title>no</title><style>x{}</style></head><body><!-- c --><h1>Head &amp; more</h1>
    <p>one <b>two</b>
    three<p hidden>no<p style="display: none">no</p><ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
    <table><tr><th>k<th>long head<tr><td>value one<td>2</table><pre>a
  b

c</pre>x<br>y<script>if (a < b) "</p>"</script><details><summary>s</summary>no</details><div>é中</div>"""
    assert html.render(page) == (
        "Head & more\n\none two three\n\n- a\n- b\n  3. x\n  4. y\n\nk          long head\nvalue one  2\n\na\n  b\n\nc\n\nx\ny\ns\né中"
    )


@pytest.mark.parametrize("page", ["", None, "plain", "a<b c<d", "<" * 3000, "<div>" * 3000 + "x", "<table><tr><td>" * 800 + "x", "<a ='" * 2000, "</p></div></table>x", "<!--x", "<script>x"])
def test_broken_pages(page):
    out = html.render(page)
    assert isinstance(out, str) and (not page or not page.endswith("x") or "x" in out or page.startswith(("<!--", "<script")))


def test_all_visible_words_stay():
    draw = random.Random(3)
    for _ in range(200):
        words = [f"w{i}" for i in range(12)]
        page = ""
        for w in words:
            page += draw.choice(["<p>", "<div>", "<li>", "<td>", "<b>", "</div>", "<tr>", "<ul>", "</ul>", "<table>", "</table>", "<br>", "</p>", "<dd>", "<h2>", "</h2>", "<ol>"]) + f" {w} "
        assert sorted(html.render(page).split()) == sorted([*words, *(x for x in html.render(page).split() if x not in words)])


def test_all_that_stands_in_tables_stays():
    assert html.render("<table><tbody><form><tr><td>x<td>y</form><tr><td>z</table>") == "x  y\nz"
    assert html.render("<table><form><tr><form><td>x</td><td>y</td></form></tr></form></table>end") == "x  y\n\nend"
    assert html.render("<table><thead>a<div>b</div><tr><th>c<tbody><caption>d</caption>e<tr><td>f<tfoot><p>g</table>") == "a\nb\nd\ne\ng\nc\nf"
    draw = random.Random(4)
    tags = [f"<{x}>" for x in ("table", "/table", "tbody", "/tbody", "thead", "tfoot", "form", "/form", "tr", "/tr", "td", "th", "/td", "div", "/div", "p", "b", "/b", "caption", "ul", "li", "blockquote", "pre")]
    for _ in range(1000):
        words = [f"w{i}" for i in range(15)]
        got = html.render("<table>" * draw.randint(0, 1) + "".join(f"{draw.choice(tags)} {w} " for w in words))
        assert sorted(x for x in got.split() if x[0] == "w") == sorted(words)


def test_depth_changes_nothing():
    inner = "<p>a</p><p>b</p><ul><li>c<li>d</ul><table><tr><td>e<td>f<tr><td>gg<td>h</table><pre>i\n  j</pre><details><summary>k</summary>no</details><div>l</div>"
    for tag in ("b", "font", "div", "span"):
        for depth in (300, 20_000):
            assert html.render(f"<{tag}>" * depth + inner) == html.render(inner)
    assert html.render("<blockquote>" * 300 + "x<p>y").splitlines()[-1] == "  " * 300 + "y"
    assert html.render("<table><tr><td>" * 1500 + "<p>x</p><p>y</p>").splitlines() == ["x", "", "y"]


def test_formulas_drawings_and_choices():
    assert html.render("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> b") == "a x= 1 2 b"
    assert html.render("<math><semantics><mrow><mi>y</mi></mrow><annotation>no</annotation></semantics><mphantom>no</mphantom></math>") == "y"
    drawing = "<svg><title>no</title><defs><text>no</text></defs><rect/>no<g><text>one <tspan>tw</tspan>o<tspan x=1>three</tspan></text><a><text><![CDATA[f<r]]></text></a></g><text display='none'>no</text><foreignObject><p>html<p>in</foreignObject></svg>z"
    assert html.render(drawing) == "one two three f<r\n\nhtml\n\nin\n\nz"
    assert html.render("<svg><defs><p>out") == "out"  # a paragraph ends a drawing
    assert html.render("<svg><defs/><text>t</text></svg>") == "t"
    assert html.render("u<select><option>a<option label=b>no<optgroup label=g><option>c<option hidden>no</select>v") == "u\na\nb\ng\nc\nv"
    assert html.render("<p>k<textarea>\n l &lt;\n  m</textarea>n") == "k\n l <\n  m\nn"


def test_extract_rows(spark):
    rows = [(1, "<p>a", "u"), (1, "<p>a", "u"), (2, None, "u"), (3, "", "v")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0)]
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    assert model.languages == ["de", "en", "es", "fr"]
    got = langid.identify(docs.where("held_out and length(text) > 20"), model)
    right, accepted = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert right > 0.97 and accepted > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... 4"), (4, "中文"), (4, "中文"), (5, "the " * 50000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = langid.identify(odd, model).collect()
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in rows if r["doc_id"] in (1, 2, 3)] == [("und", 0.0, False)] * 3
    assert all(r["lang_pred"] in model.languages and 0 <= r["score"] <= 1 for r in rows if r["doc_id"] > 3)
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_subword_sums_as_a_loop():
    texts = ["Ab été ab", "", "x"]
    data, at = textkit.buffers(pa.array(texts))
    table = np.random.default_rng(0).normal(size=(1 << langid.BITS, 3))
    got = langid.Subwords(data, at).sums(table)
    for i, text in enumerate(texts):
        total = np.zeros(4)
        for word in text.split():
            one, edge = textkit.buffers(pa.array([word]))
            total += langid.Subwords(one, edge).sums(table)[0]
        assert np.allclose(got[i], total)


def test_quality_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rated = docs.join(quality.graded(labels), "doc_id")
    model = quality.train(rated.where("doc_id % 4 <> 0"), levels=3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.rate(rated.where("doc_id % 4 = 0"), model, good=2, least=0.5).withColumn("good", F.col("grade") == 2)
    rows = {(r["good"], r["selected"]): r["count"] for r in got.groupBy("good", "selected").count().collect()}
    assert rows[True, True] > 0.97 * (rows[True, True] + rows.get((True, False), 0))
    assert rows[False, False] > 0.85 * (rows[False, False] + rows.get((False, True), 0))
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string").withColumn("selected", F.lit(1))
    assert len({(r["expected_grade"], r["tail_probability"]) for r in quality.rate(odd, model, good=2).collect()}) == 1
    none = quality.train(rated.limit(0), levels=3)
    assert quality.rate(odd, none, good=1).count() == 3
    twice = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality.graded(twice).collect()] == [(1, 0)]


def test_forest_as_single_walks():
    forest = secretscan.train(secretscan.labelled(300, seed=1))
    fresh = secretscan.labelled(400, seed=2)
    x = np.array([secretscan.describe(*f[:4]) for f in fresh])
    scores = forest.score(x)
    for row, score in zip(x[:40], scores[:40], strict=True):
        total = 0.0
        for feature, threshold, left, right, share in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= threshold[at] else right[at]
            total += share[at]
        assert abs(total / len(forest.trees) - score) < 1e-12
    assert ((scores >= 0.5) == np.array([f[4] for f in fresh], bool)).mean() > 0.97


def test_scanning(spark):
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [
        (1, f'text token = "{value}" éend', "src1"),
        (2, f"commit {value} fixed", "notes"),
        (3, None, None),
        (4, "", "x"),
        (5, "plain words of no importance whatsoever internationalisation", "x"),
        (6, "k\n-----BEGIN RSA PRIVATE KEY-----\nMIIEabc\n-----END RSA PRIVATE KEY-----\nrest", "x"),
        (1, f'text token = "{value}" éend', "src1"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("secrets", F.lit(1))
    got = secretscan.scan(docs, secretscan.train()).select("doc_id", "n_secrets", "clean_text", "secrets").collect()
    assert {(r["doc_id"], r["n_secrets"], r["clean_text"]) for r in got} == {
        (1, 1, 'text token = "[SECRET]" éend'), (2, 0, rows[1][1]), (3, 0, None), (4, 0, ""), (5, 0, rows[4][1]), (6, 1, "k\n[SECRET]\nrest"),
    }
    assert all(rows[0][1].encode()[s["start"] : s["end"]].decode() == value for r in got if r["doc_id"] == 1 for s in r["secrets"])
    assert secretscan.scan(docs.limit(0), secretscan.train(secretscan.labelled(50))).count() == 0


def test_values_of_any_length_are_judged():
    forest = secretscan.train()
    for text, wanted in [
        ('password = "S3cretPw9x"', ["S3cretPw9x"]), ("postgres://user:S3cretPassw0rd@host/db", ["S3cretPassw0rd"]), ("LONG_PREFIX_SECRET=short7Q", ["short7Q"]), ('password: "hUnter2!x", n', ["hUnter2!x"]),
        ('token = "qwhzkvbnptmxrjcdgf"', ["qwhzkvbnptmxrjcdgf"]), ("The key: never give up", []), ("password: required", []), ("max_tokens: 512", []),
    ]:
        data = np.frombuffer(text.encode(), np.uint8)
        found = secretscan.findings(data, np.array([0, len(data)]), ["src1"], forest, 0.5)[0]
        assert [text[s:e] for s, e, _ in found] == wanted
    starts, ends = secretscan.candidates(data := np.frombuffer(text.encode() * 2, np.uint8), np.array([0, len(text), len(data)]))
    assert [(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)] == [(12, 15), (27, 30)]  # values end with their rows
    parts = b"x=bcd4fgh1jklmn0p1234567890QWE=aGVsbG8gd29ybGQ1234XYZ plainlettersofanylength"
    starts, ends = secretscan.candidates(np.frombuffer(parts, np.uint8), np.array([0, len(parts)]))
    assert [parts[s:e] for s, e in zip(starts, ends, strict=True)] == [b"bcd4fgh1jklmn0p1234567890QWE", b"aGVsbG8gd29ybGQ1234XYZ", b"plainlettersofanylength"]
    assert secretscan.united([(3, 9, 0.6), (1, 4, 0.9), (9, 11, 0.5)]) == [(1, 9, 0.9), (9, 11, 0.5)]


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data).collect()
    assert 0.7 * docs.count() < len(out) <= docs.count()
    assert all(r["exact"] and len(r["ids"]) == 4 * r["n_tokens"] for r in out)
    assert len({r["doc_id"] for r in out}) == len(out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, data).columns == docs.columns


def test_near_duplicates_as_brute_force(spark):
    import corpus_pipeline

    draw = random.Random(6)
    bases = [[f"b{k}w{i}" for i in range(60)] for k in range(4)]
    text = lambda k, change: " ".join([*bases[k][: 60 - change], *(f"c{change}x{i}" for i in range(change))])
    rows = [(1, text(0, 0)), (5, text(0, 1)), (5, text(1, 0)), (6, text(2, 0)), (6, text(3, 0)), (6, text(3, 2)), (7, text(1, 1)), (8, ""), (8, "..."), (8, "..."), (None, text(0, 0)), (None, text(0, 0))]
    rows += [(draw.randint(9, 30), text(draw.randrange(4), draw.choice([0, 1, 2, 20]))) for _ in range(30)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    class_of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and (rows[i] == rows[j] or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                class_of = [class_of[j] if c == class_of[i] else c for c in class_of]
    wanted = [min(r for r, c in zip(rows, class_of, strict=True) if c == k) for k in set(class_of) if rows[k][0] is not None or class_of.count(k) == 1]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str) and {t for i, t in got if i == 5} >= {text(1, 0)}


def test_a_sample_is_bounded_on_ties(spark):
    """Of 3,000 rows of one doc_id, and of rows without one, no more than the sample goes to the driver."""
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), (F.col("id") % 3).cast("int").alias("grade"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(5)
    tied = rows.select(F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("name"), "grade", "text")
    got = textkit.chosen(tied.unionByName(tied), "grade", 50).collect()
    assert len(got) == 150 and len({(r["grade"], r["text"]) for r in got}) == 150
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    every = sorted((r["name"], signed(xxhash.xxh64_intdigest(r["text"].encode(), 42)), r["text"]) for r in tied.where("grade = 1").collect())
    assert {r["text"] for r in got if r["grade"] == 1} == {t for *_, t in every[:50]}


def test_graded_texts_are_chosen_by_id(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(3, "b"), (3, "a"), (5, None), (None, "x")], "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, grade int")
    got = quality.sampled(docs, grades, 10).collect()
    assert len(got) == 20 and all(r["grade"] == r["doc_id"] % 2 for r in got)
    assert {(r["doc_id"], r["text"]) for r in quality.sampled(docs, grades, 1000).collect()} == {(i, "a" if i == 3 else f"t{i}") for i in range(40)}
    assert quality.sampled(docs.limit(0), grades).count() == 0


def test_scores_as_written_out(spark):
    """Expected grade and tail from the model's weights, feature by feature."""
    import numpy as np

    draw = np.random.default_rng(1)
    model = quality.Model(draw.normal(size=1 << quality.BITS), np.array([-0.5, 0.75]))
    texts = ["Some words, some MARKS!! and 12", "", None, "again again again", "été"]
    got = quality.rate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, good=2).collect()
    weights = model.weights.astype(np.float32)
    for r in got:
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        _, bucket, value = quality.features(raw, np.array([0, len(raw)]))
        score = sum(float(weights[b]) * float(v) for b, v in zip(bucket, value, strict=True))
        tails = [1 / (1 + math.exp(t - score)) for t in (-0.5, 0.75)]
        assert abs(r["expected_grade"] - sum(tails)) < 1e-6 and abs(r["tail_probability"] - tails[1]) < 1e-6 and r["selected"] == (tails[1] >= 0.5)


def test_gradient_of_the_ordinal_loss():
    """One step of a fit from zero goes down the loss as finite differences do."""
    import numpy as np

    bags = [(np.array([i % 3, 3 + i % 2], np.int32), np.ones(2)) for i in range(32)]
    grades = np.array([i % 3 for i in range(32)])
    before, after = quality.fit(bags, grades, 3, epochs=1), quality.fit(bags, grades, 3, epochs=40)

    def loss(m):
        cuts = np.concatenate([[-np.inf], m.thresholds, [np.inf]])
        total = 0.0
        for (b, v), y in zip(bags, grades, strict=True):
            s = float((m.weights[b] * v).sum())
            total -= math.log(1 / (1 + math.exp(min(s - cuts[y + 1], 500))) - 1 / (1 + math.exp(min(s - cuts[y], 500))))
        return total

    assert loss(after) < 0.5 * loss(before) and (np.diff(after.thresholds) > 0).all()


def test_visibility_and_sizes_of_tables():
    assert html.render("a<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no<ul><li>no<li style=visibility:visible>li</ul></div>z") == "a\nyes\n\n- li\n\nz"
    assert html.render("<p style='visibility:hidden'>no<p style='display:none'>no<span style='visibility:visible'>no</span>") == ""
    assert html.render("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>x<tr style='visibility:visible'><td>y</table>").split() == ["x", "y"]
    wide = "<table><tr><td>" + "x" * 50_000 + "<td>end" + "<tr><td>a<td>b" * 3000 + "</table>"
    assert len(html.render(wide)) < 6 * len(wide)
    far = "<table><tr>" + "".join(f"<td>{'y' * 80}" for _ in range(900)) + "<tr><td colspan=899><td>x" * 2000 + "</table>"
    assert len(html.render(far)) < 6 * len(far) and html.render(far).split().count("x") == 2000
    nest = "<table><tr><td>" + "<table><tr><td>aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa<tr><td>b<td>" * 200
    assert len(html.render(nest)) < 60 * len(nest)


def test_the_driver_gives_memory_back_after_training(spark, monkeypatch):
    """The driver's Python stays beside all later stages of the pipeline."""
    called = []
    monkeypatch.setattr(textkit, "trim", lambda: called.append(1))
    langid.train(spark.createDataFrame([(i, "ein wort" if i % 2 else "a word", "de" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string"))
    assert called


def test_alignment_does_not_depend_on_the_size_of_a_table():
    head = "<tr>" + "".join(f"<td>{c * 80}" for c in "pqr") + "<td>end"
    far = "<tr><td>a<td>b<tr><td colspan=3><td>x"
    for n in (1, 3000):  # rows; once, those of many rows were set apart by two spaces alone
        lines = html.render(f"<table>{head}{far * n}</table>").splitlines()
        assert lines[1:] == ["a" + " " * 81 + "b", " " * html.GAP + "x"] * n
    near = "<tr><td>" + "y" * 70 + "<td>z" + "<tr><td>s<td>t" * 5000
    assert {x.index("t") for x in html.render(f"<table>{near}</table>").splitlines()[1:]} == {72}
    inner = "<p>x" * 200
    for _ in range(50):  # gaps of tables in tables don't add up
        inner = f"<table><tr><td>{'w' * 79}<td>{inner}</table>"
    assert max(len(x) - len(x.lstrip()) for x in html.render(inner).splitlines()) == html.GAP


def test_tables_as_a_matrix():
    """Random tables with spans against a matrix of columns, filled cell by cell."""
    draw = random.Random(9)
    for _ in range(300):
        height, rows, matrix = draw.randint(1, 6), [], {}
        for r in range(height):
            cells, c = [], 0
            for k in range(draw.randint(0, 4)):
                while (r, c) in matrix:
                    c += 1
                wide, high = draw.choice([1, 1, 2, 3]), draw.choice([1, 1, 2, 3])
                word = f"w{r}{k}" + "o" * draw.randint(0, 9)
                for i in range(r, r + high):
                    for j in range(c, c + wide):
                        matrix.setdefault((i, j), None)
                matrix[r, c] = word
                cells.append(f"<td colspan={wide} rowspan={high}>{word}")
                c += wide
            rows.append("<tr>" + "".join(cells))
        texts = {k: v for k, v in matrix.items() if v}
        used = sorted({c for _, c in texts})
        start, at = {}, 0
        for i, c in enumerate(used):
            start[c] = at
            if i + 1 < len(used):
                at += max(len(v) for (_, j), v in texts.items() if j == c) + 2 * min(2, used[i + 1] - c)
        want = []
        for r in range(height):
            line = ""
            for c in used:
                if (r, c) in texts:
                    line = line.ljust(start[c]) + texts[r, c]
            if line:
                want.append(line)
        got = html.render("<table>" + "".join(rows) + "</table>")
        assert [x.strip() for x in got.splitlines() if x] == [x.strip() for x in want]
        assert "\n".join(x for x in got.splitlines() if x) == "\n".join(want)


def test_columns_under_cells_of_earlier_rows():
    """Against a dictionary of columns, with cells that cross."""
    r = random.Random(4)
    for _ in range(300):
        taken, plain = html.Taken(), {}
        for row in range(12):
            taken.row(row)
            plain = {c: until for c, until in plain.items() if until > row}
            column = 0
            for _ in range(r.randrange(4)):
                want = column
                while want in plain:
                    want += 1
                assert taken.free(column) == want
                wide, high = r.randrange(1, 4), r.randrange(2, 6)
                taken.take(want, want + wide, row + high)
                plain |= {c: max(row + high, plain.get(c, 0)) for c in range(want, want + wide)}
                column = want + wide


def test_odd_spans_and_many_of_them():
    for value, width in (("²", 1), ("①", 1), ("٣", 1), ("2px", 2), (" +3", 3), ("-2", 1), ("0", 1), ("9" * 5000, 1000), ("", 1), ("x", 1)):
        page = f"<table><tr><td colspan='{value}'>a<td>b<tr><td>c" + "<td>d" * (width + 1) + "</table>"
        assert html.render(page).split() == ["a", "b", "c"] + ["d"] * (width + 1)
        assert html.render(f"<table><tr><td rowspan='{value}'>a<td>b<tr><td>c</table>").split() == ["a", "b", "c"]
    start = time.perf_counter()
    for n in (500, 4000):
        html.render("<table><tr>" + "<td colspan=1000 rowspan=65534>x" * n + "<tr><td>y" * n + "</table>")
        html.render("<table>" + "<tr><td rowspan=65534>x" * n + "</table>")
        html.render("<table>" + "<tr><td rowspan=99>x<td colspan=9>y" * n + "</table>")
    assert time.perf_counter() - start < 20
