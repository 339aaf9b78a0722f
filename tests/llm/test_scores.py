"""Quality, toxicity, language model, rules and page texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orrery.llm import backoff_lm, html_wrapper, line_crf, quality_rules, toxicity
from orrery.llm.calibration import isotonic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeat_words(w, n=5):
    count = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    on = set()
    for k in range(len(w) - n + 1):
        if count[tuple(w[k : k + n])] > 1:
            on |= set(range(k, k + n))
    return len(on)


def test_statistics_against_brute_force(docs, rows, labels):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.judged(docs, labels).collect())
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = repeat_words(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w))] += 1
    assert got == want


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    y = 1.0 - ((x[:, 2] > 0.6) & (x[:, 5] < 0.4))
    rules = quality_rules.learn(x, y)
    bad = np.zeros(len(x), bool)
    for r in rules:
        bad |= quality_rules.holds(r, x)
    assert (y[bad] == 0).mean() > 0.93 and bad[y == 0].mean() > 0.9
    assert quality_rules.learn(x, np.ones(len(x))) == [] and quality_rules.learn(x[:0], y[:0]) == []


def test_rules_without_labels(docs, labels, none):
    kept = quality_rules.judged(docs, labels.limit(0))
    assert kept.where("kept = base_failed").count() == 0
    assert quality_rules.judged(none, labels).count() == 0


def made(kind, rng, n):
    out = []
    for k in range(n):
        w = ["w%d" % rng.randrange(900) for _ in range(60)]
        y = k % 3 == 0
        if kind == "toxic" and y:
            w[rng.randrange(60)] = rng.choice(["ugly", "Vermin!", "ver.min", "uglyyy"])
        text = " ".join(w[:30]) + "\n" + " ".join(w[30:])
        if kind == "quality":
            y = not y
            text = text if y else text.replace("\n", "\n###") + "\n" + "$$$ " * 20
        out.append((text, int(y)))
    return out


@pytest.mark.parametrize(("model", "kind"), [(toxicity.Model, "toxic"), (line_crf.Model, "quality")])
def test_held_out_accuracy(model, kind):
    rows = made(kind, random.Random(2), 600)
    m = model(rows[:400])
    s = m.scores([t for t, _ in rows[400:]] + [""])
    right = [(p >= 0.5) == bool(y) for p, (_, y) in zip(s, rows[400:], strict=False)]
    assert np.mean(right) > 0.95 and ((0 <= s) & (s <= 1)).all()


@pytest.mark.parametrize("run", [toxicity.toxicity, line_crf.quality])
def test_scores_of_odd_rows(docs, labels, rows, none, run):
    got = run(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert run(none, labels).count() == 0
    flat = {r["score"] for r in run(docs, labels.limit(0)).collect()}
    assert flat == {0.5}


def test_isotonic():
    kx, ky = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0, 1, 0, 1, 1]))
    assert list(np.interp([1, 2, 3, 4, 5], kx, ky)) == [0, 0.5, 0.5, 1, 1]


def test_field_marginals_against_enumeration():
    field = line_crf.Field()
    rng = np.random.default_rng(1)
    field.w, field.t = rng.normal(size=line_crf.FEATURES), rng.normal(size=(2, 2))
    lines = line_crf.Lines(["a b\nc d e\nF G!\nx", "one\ntwo three", ""])
    got, _ = field.marginals(lines)
    u = lines.x @ field.w
    for d in range(2):
        at = np.flatnonzero(lines.doc == d)
        weight = {}
        for code in range(2 ** len(at)):
            y = [code >> k & 1 for k in range(len(at))]
            weight[tuple(y)] = math.exp(sum(u[a] * v for a, v in zip(at, y, strict=True)) + sum(field.t[p, q] for p, q in zip(y, y[1:], strict=False)))
        z = sum(weight.values())
        for k, a in enumerate(at):
            assert got[a] == pytest.approx(sum(v for y, v in weight.items() if y[k]) / z)


def brute_force_language_model(rows, order):
    """Scores by the definition: the arc of the longest context that has one, after the failure arcs on the way."""
    lower = {i: i + 32 for i in range(65, 91)}
    tokens = [[*WORD.findall((r[1] or "").translate(lower)), "\n"] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    seen = [Counter() for _ in range(order + 1)]  # by length
    left = Counter()  # how often a context was left
    for t, h in zip(tokens, held, strict=True):
        for k, w in enumerate(t):
            for length in range(1, order + 1):
                context = tuple(["\t", *t][max(0, k + 2 - length) : k + 1])
                if not h and len(context) == length - 1:
                    seen[length][*context, w] += 1
                    left[context] += 1
    c = Counter({w: n for (w,), n in seen[1].items()})
    n, v = sum(c.values()), len(c)
    clip = lambda x: min(max(x, 0.05), 0.95)
    n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = clip(n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5)
    share = [0, 0, *[clip(sum(x == 1 for x in s.values()) / sum(s.values())) for s in seen[2:]]]

    def probability(context, w):
        if not context:
            return (c[w] - d) / n if c[w] else d * v / n
        shorter = probability(context[1:], w)
        if not left[context]:
            return shorter
        part = share[len(context) + 1]
        return (1 - part) * seen[len(context) + 1][*context, w] / left[context] + part * shorter

    want = Counter()
    for r, t, h in zip(rows, tokens, held, strict=True):
        score = sum(math.log10(probability(tuple(["\t", *t][max(0, k + 2 - order) : k + 1]), w)) for k, w in enumerate(t))
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want[(r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(base, 5), round(score, 5))] += 1
    return want


@pytest.mark.parametrize(("order", "direct"), [(1, 12), (2, 12), (3, 12), (3, 1), (4, 3)])
def test_language_model_against_brute_force(docs, rows, none, monkeypatch, order, direct):
    """Whether units write to buckets or to relays, the scores are those of the definition."""
    monkeypatch.setattr(backoff_lm, "UNIT", 10_000)
    monkeypatch.setattr(backoff_lm, "BUCKET", 6_000)
    monkeypatch.setattr(backoff_lm, "DIRECT", direct)
    got = Counter((*tuple(r)[:5], round(r["base_score"], 5), round(r["score"], 5)) for r in backoff_lm.scores(docs, order=order).collect())
    assert got == brute_force_language_model(rows, order)
    assert backoff_lm.scores(none, order=order).count() == 0


def test_packed_keys():
    """Sorted keys come back from their differences, and parts of any number of bits hold the keys with those bits."""
    rng = np.random.default_rng(0)
    for bits, n in ((0, 0), (0, 1), (3, 5000), (16, 5000), (18, 40)):
        for order in (1, 2):
            width = backoff_lm._width(order, bits)
            keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) >> np.uint64(63 - bits - width if bits + width < 64 else 0))
            cut, low = backoff_lm._split(keys, bits, width)
            assert list(np.diff(cut)) == list(np.bincount((keys >> np.uint64(width)).astype(np.int64), minlength=1 << bits))
            for b in range(0, 1 << bits, 97):
                part = low[cut[b] : cut[b + 1]]
                assert list(backoff_lm._unpack(backoff_lm._pack(part))) == list(part)
                assert list(part + (np.uint64(b) << np.uint64(width))) == list(keys[cut[b] : cut[b + 1]])


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>{title}</title><script>x('<p>')</script></head><body><nav><ul><li>Home</li><li>More</li></ul></nav>{extra}<article><h1>{title}</h1>{body}</article><div class='sidebar'>buy</div><div id=\"comments\"><p>first!</p></div><footer>&copy; us</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", page(f"T{i}", [f"one &amp; {i}", "two\n  <b>bold</b>ly"][: 1 + i % 2], "<div class='ad'>!</div>" * (i % 2))) for i in range(9)]
    rows += [(20, None, None), (21, "nonsense", "<p>loose text"), (22, "http://b.example/", "<div class=cookie-notice>ok</div><div><p>main text<p>more</div>"), (None, "http://a.example/z", page("Z", ["q"])), (3, rows[3][1], rows[3][2])]
    got = Counter(tuple(r) for r in html_wrapper.extracted(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect())
    want = Counter()
    for i, u, _ in rows[:9] + rows[13:]:
        t = " ".join([f"T{i}", f"one & {i}", "two boldly"][: 2 + i % 2])
        want[(i, u, t, len(t))] += 1
    for i, u, t in ((20, None, ""), (21, "nonsense", "loose text"), (22, "http://b.example/", "main text more"), (None, "http://a.example/z", "Z q")):
        want[(i, u, t, len(t))] += 1
    assert got == want
    assert html_wrapper.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_is_union_free():
    found = html_wrapper.infer([page(f"t{i}", ["a"] * (i + 1)) for i in range(4)])
    assert ["+", ["<p", "T", "</p"]] in found["wrapper"] and found["main"]


def test_pages_of_another_template_keep_their_article(spark):
    """One page without a main container among many copies of a page with one, and menus that only many pages tell."""
    rows = [(i, f"http://a.example/{i}", page("T", ["one"])) for i in range(200)]
    rows += [(500, "http://a.example/other", "<html><body><div><h2>Other</h2><p>its own article</p></div></body></html>")]
    rows += [(600 + i, f"http://b.example/{i}", f"<body><div>Home</div><div><p>text {max(0, i - 60)}</p></div></body>") for i in range(64)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[500] == "Other its own article" and {got[i] for i in range(200)} == {"T one"}
    assert [got[600 + i] for i in range(64)] == [f"text {max(0, i - 60)}" for i in range(64)]


def neutral_page(k, rng):
    """A page whose names say nothing: a menu, a list of other pages, an article, a notice and a last line."""
    say = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    body = [say(30) for _ in range(1 + k % 4)]
    others = "".join(f"<li><a href='/{rng.randrange(99)}'>{say(3)}</a></li>" for _ in range(3 + k % 3))
    menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Start", "Archive", "About"))
    notice = "<div class=qe><p>This site keeps small files on your machine.</p></div>" if k % 2 else ""
    article = f"<h1>Title {k}</h1>" + "".join(f"<p>{p} <a href='/x'>link {k}</a> on.</p>" for p in body)
    html = f"<body><div class=qa><ul>{menu}</ul></div>{notice}<div class=qb>{article}</div><div class=qc><ul>{others}</ul></div><div class=qd>All rights with us</div></body>"
    return html, " ".join([f"Title {k}", *[f"{p} link {k} on." for p in body]])


def test_wrapper_on_pages_with_neutral_names(spark):
    """Only what the wrapper knows of the host tells the article here; the containers alone get no page right."""
    rng = random.Random(5)
    made = [neutral_page(k, rng) for k in range(40)]
    got = html_wrapper.extracted(spark.createDataFrame([(k, f"http://n.example/{k}", h) for k, (h, _) in enumerate(made)], "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {k: t for k, (_, t) in enumerate(made)}
    found = html_wrapper.infer([h for h, _ in made])
    assert [html_wrapper.Wrapper(found["wrapper"], found["keep"]).text(h) for h, _ in made] == [t for _, t in made]
    assert all(html_wrapper.Wrapper([], []).text(h) != t for h, t in made)


def test_page_and_wrapper_meet_again_however_far():
    """A long body that the wrapper lacks, before a part that it has."""
    wrapper = ["<div q", "T", "</div", "<p last", "T", "</p"]
    symbols = ["<div q", "T", "</div", *["<section", "T", "</section"] * 500, "<p last", "T", "</p"]
    got = html_wrapper.Parser(wrapper).parse(symbols)
    assert got[1] == 0 and got[-2] == 1 and set(got[3:-3]) == {-1}
    assert html_wrapper.Parser(["<div", "T", "</div", "<gone", "<p", "T"]).parse(["<div", "T", "</div", "<p", "T"]) == [-1, 0, -1, -1, 1]
