import random
import zlib

import numpy as np

from riskops.llm import html, toxicity

from .helpers import docs, hostile, words

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head>
<body class="home post-%d"><nav><ul><li><a href="/a">Menu %d</a></li></ul></nav><!-- ad <p>no</p> --><div class="cookie-notice">Cookies!</div>
<div class="ad">Buy %d</div><div id="content"><article id="post-%d"><h1>Head %d</h1><p><b>Bold
 text &lt;%d&gt;<br><p class="adept">Second   one%s</p><form>mail <input></form><table><tr><td>c1<td>c2</table></article>
<section class="comments"><p>nasty reader %d</p></section></div><aside>side</aside><footer>&copy; host</footer>%s"""


def page(i, closed=True):
    return PAGE % (i, i, i, i, i, i, "&#33;" * (i % 3), i, "</body></html>" if closed else "")


def test_article_text(spark):
    rows = [(i, f"https://h{i % 3}.example/x/{i}?q#f", page(i, i % 2 == 0)) for i in range(30)]
    rows += [(100, None, None), (101, "https://lone.example/", "<p>a <i>b</i>c</p><p>d<p>e"), (102, "https://h1.example/other", "<div><p>only</p><script>x"), (103, "", ""),
             (104, "https://h1.example/y", "no markup < at all & none"), (0, rows[0][1], rows[0][2]), (105, "u", "<!-- never closed <p>x")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, token string")
    got = {r.page_id: r.text for r in html.extract(frame).collect()}
    assert html.extract(frame).count() == len(rows)
    for i in range(30):
        assert got[i] == f"Head {i}\nBold text <{i}>\nSecond one{'!' * (i % 3)}\nc1\nc2"
    assert got[100] == got[103] == got[105] == "" and got[101] == "a bc\nd\ne" and got[102] == "only" and got[104] == "no markup < at all & none"
    assert html.extract(frame.limit(0)).count() == 0


def test_words_of_the_template_go_from_the_slot(spark):
    r = random.Random(11)
    body = [words(30, 500 + i) for i in range(40)]
    tail = [" ".join(r.sample(["uno", "dos", "tres", "cuatro"], 4)) for _ in range(40)]  # on each page, in no fixed order
    html_of = lambda i: f"""<html><body><div class="q1"><h1>Head</h1><div class="z9">Grab our bargain deals</div><div class="m">{body[i]}</div>
<div class="k">Posted by <b>n{i}</b> in town</div>{'<div class="o">Only members see this</div>' if i % 3 else ''}<div class="t">{tail[i]}</div></div></body></html>"""  # noqa: E731
    rows = [(i, f"https://many.example/{i}", html_of(i)) for i in range(40)]
    rows += [(100 + i, f"https://few.example/{i}", html_of(i)) for i in range(5)]
    rows += [(200 + i, f"https://same.example/{i}", html_of(0)) for i in range(40)]  # equal pages are one
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = lambda i: "\n".join(["Head", "Grab our bargain deals", body[i], f"Posted by n{i} in town", *["Only members see this"] * (i % 3 > 0), tail[i]])
    assert all(got[i] == f"{body[i]}\nn{i}\n{tail[i]}" for i in range(40))
    assert all(got[100 + i] == whole(i) for i in range(5)) and all(got[200 + i] == whole(0) for i in range(40))


def labelled(n=500):
    r = random.Random(5)
    bad = ["scumbag", "idiotic", "pathetico", "worthless"]
    common = words(500, 99).split()  # a language's texts share their words
    rows, labels = [], []
    for i in range(n):
        w = r.choices(common, k=r.randint(20, 200))
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "xy", "zzz"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "a"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    marks = spark.createDataFrame(labels + [labels[0], (None, 1, 1), (9_999, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    more = hostile()
    frame = docs(spark, rows + [(10_000 + k, *x[1:]) for k, x in enumerate(more)])
    got = {r.doc_id: r for r in toxicity.score(frame, marks).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, *_ in rows)
    right = [got[i].predicted == labels[i][2] for i in held]
    assert np.mean(right) >= 0.95 and len(got) == len(rows) + len(more)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_every_labelled_row_trains(spark, monkeypatch):
    """More rows than one shard: all are there, and what only some shards have seen is learnt."""
    rows, labels = labelled(900)
    many = [(10_000 + k, f"calm w{k % 50}", None, "a") for k in range(4_000)]
    frame = docs(spark, rows + many)
    marks = spark.createDataFrame(labels + [(r[0], 1, 0) for r in many], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(frame, marks)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r[0] for r in rows + many if zlib.crc32(str(r[0]).encode()) % 5}
    few = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert 900 <= toxicity.may_be_in(frame, few).count() < 920  # the map of ids lets hardly any other text by
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 120)
    model, limits = toxicity.train(docs(spark, rows), few)
    again, _ = toxicity.train(docs(spark, rows).repartition(3), few)
    assert all(np.array_equal(x, y) for p, q in zip(model.products, again.products) for x, y in zip(p, q)) and {"en", "de", ""} <= set(limits)
    codes = toxicity.WordCodes()
    held = [(text, labels[i][2]) for i, text, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = (model([toxicity.word_codes(t, codes) for t, _ in held]) >= 0.5) == np.array([y for _, y in held])
    assert right.mean() >= 0.95


def test_tables_equal_the_network():
    net = toxicity.Network(3)
    codes = toxicity.WordCodes()
    texts = [toxicity.word_codes(t, codes) for t in ("", "a", "a b", "x y z " * 40, None, "Ünï, çödé!")]
    pooled, _ = net.pool(texts)
    hidden = np.maximum(pooled + net.bias.ravel(), 0)
    want = 1 / (1 + np.exp(-(hidden @ net.out + net.shift)))
    assert np.allclose(net.tables()(texts), want, atol=1e-5)


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs(spark, hostile()), none).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), none).count() == 0
