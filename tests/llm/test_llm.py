"""The training-data operators against brute force, exact round trips and odd inputs."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import chatformat, decontam, fingerprint, htmltext, langid, neardup, packing, quality, sharding, tokencount
from strandweave.llm.common import held_out
from strandweave.session import shared_dir

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \n\t ", "a", "one two three", "ß é 世界 \U0001f600", "!!! ???", "x" * 30_000, "word " * 4000]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # columns whose names an operator uses itself
    return df.selectExpr("*", *(f"'x' as {c}" for c in ("shard", "kept", "score", "group", "sketch"))) if extra else df


def brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_texts():
    rng = random.Random(1)
    base = [words(rng, 200) for _ in range(4)]
    out = list(ODD)
    for b in base:
        out += [b, b.upper(), b + " tail"]
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(1, 8)):
                w[rng.randrange(len(w))] = words(rng, 1)
            out.append(" ".join(w))
    passage = words(rng, 60)
    out += [passage + " " + words(rng, 50) for _ in range(70)]  # a long list without links
    return out


def test_near_duplicates(spark):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_components(texts)
    kept = neardup.keep_one(documents(spark, texts))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {c for _, c in got.values()}
    assert kept.columns == documents(spark, texts).columns


@pytest.mark.parametrize(("broadcast", "rows", "shingles", "few"), [(-1, 256, 10**6, 500), (10**6, 2, 10**6, 0), (10**6, 256, 300, 500)])
def test_near_duplicates_in_small_blocks_without_broadcast(spark, monkeypatch, broadcast, rows, shingles, few):
    monkeypatch.setattr("strandweave.session.BROADCAST_ROWS", broadcast)
    for name, value in (("BLOCK_ROWS", rows), ("BLOCK_SHINGLES", shingles), ("FEW_PAIRS", few)):
        monkeypatch.setattr(neardup, name, value)
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_write_few_files_from_many_partitions(spark):
    """Each file has an executor start processes: 60 partitions of a few rows are not 60 files."""
    folder, many = shared_dir(spark), {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, old = set(os.listdir(folder)), {name: spark.conf.get(name, None) for name in many}
    texts = near_texts()
    try:
        for name, value in many.items():
            spark.conf.set(name, value)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts).coalesce(2)).collect()}
        kept = neardup.keep_one(documents(spark, texts).coalesce(2)).count()
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert got == brute_components(texts)
    assert kept == len({c for _, c in got.values()})
    files = [sum(x.startswith("part-") for x in os.listdir(f"{folder}/{table}")) for table in set(os.listdir(folder)) - before]
    assert len(files) > 20 and max(files) <= 2


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)], key=str)


def test_keep_one_of_ids_with_several_texts(spark):
    own, copy, other = "the own text of number five", "a text that number three has", "yet another text under five again"
    rows = [(3, copy), (5, own), (5, copy), (5, own), (5, other), (6, own), (7, other.upper()), (8, ""), (8, None), (None, own)]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, copy), (5, own), (5, other), (8, ""), (8, None), (None, own)], key=str)


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header>"
    "<nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class='sidebar'>side</div><!-- <p>gone</p> --><article><h1>Head %d</h1>"
    "<p>First&nbsp;&amp; \n second %d<br>line<p><b>bold</b> text %d &eacute;</p><div class='ad'>buy</div><ul><li>one<li>two %d</ul>"
    "<form><input value=1>go</form><section class='comments'><p>first!</p></section></article><aside>more</aside><footer>&copy;</footer></body></html>"
)


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE % (i, i, i, i)) for i in range(12)] + [(90, None, None), (91, "x", ""), (92, "http://h0.example/odd", "<p>a<p>b &lt;c>"), (93, "u", "plain"), (94, "u", "<div>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_text(pages).collect()}
    for i in range(12):
        assert got[i][0] == f"Head {i}\nFirst & second {i} line\nbold text {i} é\none\ntwo {i}"
    assert got[90] == got[91] == ("", 0) and got[92][0] == "a\nb <c>" and got[93] == ("plain", 5) and got[94] == ("deep", 4)
    wrapper = {r.host: r.wrapper for r in htmltext.wrappers(pages).collect()}["h0.example"]
    assert "#" in wrapper and ")?" in wrapper
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_html_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", -1)
    pages = spark.createDataFrame([(i, "http://h.example/", PAGE % (i, i, i, i)) for i in range(9)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    assert all(got[i].startswith(f"Head {i}\nFirst & second") for i in range(9))


def test_html_second_template(spark):
    # one page in ten has its article beside the container of the others, which holds a teaser there
    usual = "<body><div class=top>Site</div><div class=a><p>%d text of the page, as usual, with a good many words</p></div></body>"
    other = "<body><div class=top>Site</div><div class=a>teaser %d</div><div class=b><p>the article of page %d</p></div></body>"
    rows = [(i, "http://h.example/", other % (i, i) if i % 10 == 0 else usual % i) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    for i in range(200):
        assert got[i] == (f"teaser {i}\nthe article of page {i}" if i % 10 == 0 else f"{i} text of the page, as usual, with a good many words")
    found = htmltext.wrappers(pages).first()
    assert found.n_pages == 200 and "(<div.b>" in found.wrapper
    assert htmltext.wrappers(pages.union(pages).repartition(7)).first() == found


@pytest.mark.parametrize("n", [1, 20])
def test_html_without_article(spark, n):
    body = "<h1>Title %d</h1><div class=lead>Lead %d, some thirty parts of a hundred.</div><div class=body>Body %d, which holds most of what the whole page has to say, and goes on for a good while after that, well past two thirds.</div>"
    layouts = [f"<body><nav>menu</nav><main>{body}</main></body>", f"<body><nav>menu</nav><div id=w>{body}</div><footer>f</footer></body>", f"<body>{body}<p class=c>All rights reserved.</p></body>"]
    rows = [(i * 3 + j, f"http://h{j}.example/", x % (i, i, i)) for i in range(n) for j, x in enumerate(layouts)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(n):
        text = f"Title {i}\nLead {i}, some thirty parts of a hundred.\nBody {i}, which holds most of what the whole page has to say, and goes on for a good while after that, well past two thirds."
        # what all of many pages have alike is boilerplate, of one page nobody can tell
        assert [got[i * 3 + j] for j in range(3)] == [text, text, text if n > 1 else f"{text}\nAll rights reserved."]


def labelled(spark, n=400):
    rng = random.Random(2)
    texts, good = [], []
    for i in range(n):
        t = words(rng, rng.randint(20, 120)) + "."
        if i % 4 == 0:
            t = t.upper().replace(" ", "!! ") if i % 8 else t.replace(" ", "$$$ ")
        texts.append(t)
        good.append(int(i % 4 != 0))
    labels = spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    return texts, good, labels


def test_quality(spark):
    texts, good, labels = labelled(spark)
    docs = documents(spark, texts + ODD)
    model = quality.train(docs, labels)
    rows = quality.predict(docs, model).collect()
    held = [r for r in rows if r.held_out and r.doc_id < len(good)]
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == good[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if r.predicted}
    # flattened trees against a walk node by node
    x = np.stack([quality.statistics(t) for t in texts[:20]])
    slow = []
    for row in x:
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.score(x), slow)
    assert quality.predict(docs, quality.train(docs, labels.limit(0))).where("score = 0.5").count() == docs.count()


def test_language(spark):
    rng = random.Random(3)
    make = {"en": "thingaroe", "de": "schüberkß"}
    texts = [" ".join("".join(rng.choice(make["en" if i % 2 else "de"]) for _ in range(5)) for _ in range(30)) for i in range(200)]
    docs = documents(spark, texts + ODD)
    model = langid.train(docs)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert np.mean([rows[i].lang_pred == ("en" if i % 2 else "de") for i in range(200) if rows[i].held_out]) > 0.97
    und = {i for i, t in enumerate(texts + ODD) if not any(c.isalpha() for c in t or "")}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == und
    # gathered log probabilities against a count by hand
    text = "Ab c"
    got = sum(model.logp[b].sum(axis=0, dtype=np.float64) for b in langid._each_gram(text)) + model.prior
    codes, slow = [32, 97, 98, 32, 99, 32], model.prior.copy()
    for order in langid.ORDERS:
        for i in range(len(codes) - order + 1):
            if codes[i] != 32 or (order > 1 and codes[i + 1] != 32):
                h = order
                for j in range(order):
                    h = (h + codes[i + j]) * int(langid._MIX[j]) % 2**64
                slow += model.logp[(h ^ (h >> 29)) % langid.BUCKETS]
    assert np.allclose(got, slow, atol=1e-3)
    assert langid.predict(docs, langid.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def brute_hits(text, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        b = split(t)
        k = min(13, len(b))
        for j in range(len(b) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == b[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(item)
    return len(w), len(hit), found


def test_decontamination(spark):
    rng = random.Random(4)
    small = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, words(rng, 30)) for i in range(5)] + [(10, "Short item here"), (11, "here"), (12, ""), (13, None), (14, small(40)), (15, small(20)), (16, "a b a b a")]
    texts = [*ODD, "He said: short, ITEM here! Yes", items[0][1], words(rng, 40) + " " + items[1][1][:80] + " " + words(rng, 30), words(rng, 400) + " " + items[2][1] + " " + words(rng, 500)]
    texts += [small(rng.randint(5, 60)) for _ in range(60)]
    texts += [" ".join(items[3][1].split()[:12]) + " end", " ".join(items[3][1].split()[5:18])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (10**6, 30):
        scan = [decontam.SuffixAutomaton().build([(i, decontam.words(t)) for i, t in items])] if block > 100 else decontam.automata(bench, block_words=block)
        for t in texts:
            n, hit, found = brute_hits(t, items)
            got = [a.scan(decontam.words(t)) for a in scan]
            spans = decontam._merged([g[0] for g in got])
            assert (len(decontam.words(t)), sum(b - a for a, b in spans), set().union(*(g[1] for g in got))) == (n, hit, found), t
    rows = {r.doc_id: r for r in decontam.report(documents(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].contaminated) == (n, hit, len(found), hit > 0 and 20 * hit >= n)
        assert rows[i].items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    clean = {r.doc_id: r for r in decontam.clean(documents(spark, texts), bench).collect()}
    assert set(clean) == {i for i in rows if not rows[i].contaminated}
    for i, r in clean.items():
        assert r.text == texts[i] if not rows[i].n_hit else (brute_hits(r.text, items)[0] == rows[i].n_words - rows[i].n_hit and r.n_chars == len(r.text))
    assert decontam.report(documents(spark, texts[:3]), bench.limit(0)).where("n_hit > 0").count() == 0


def test_templates():
    run = lambda t, **v: "".join(x for x, _ in chatformat.compile_template(t)(**v))
    assert run("{# c #}a{{ 'b' + 1 + 2 }}{% if 1 == 2 %}x{% elif not false %}y{% else %}z{% endif %}") == "ab12y"
    assert run("{% for m in ms %}{{ loop_index }}{{ m.role|upper }}{% endfor %}", ms=[{"role": "u"}, {"role": "<"}]) == "0U1<"
    assert chatformat.fold(chatformat.parse("{% if true %}a{{ 'b' }}{% endif %}c")) == ("block", [("text", "abc")])
    assert list(chatformat.compile_template("a{% generation %}{{ x }}{% endgeneration %}")(x="g")) == [("a", False), ("g", True)]
    for bad in ("{{ __import__ }}", "{{ x.__class__ }}", "{{ f() }}", "{% if %}", "{% for x %}{% endfor %}", "{% if a %}", "{{ x|eval }}", "{% import os %}", "{{ 'a }}"):
        with pytest.raises(chatformat.TemplateError):
            chatformat.parse(bad)
    with pytest.raises(chatformat.TemplateError):
        run("{{ x.upper }}", x="text")
    for text in ("</s>[INST]&lt;&amp;", "&&<>[]", "", "&lb;"):
        assert chatformat.unescape(chatformat.escape(text)) == text and not re.search(r"[<>\[\]]", chatformat.escape(text))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s><s>[user]\nhi"), (1, 0, "user", "&amp; é"), (2, 0, None, None), (3, None, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 0, "system", "s")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chatformat.digests(table).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {1: ("user\n&amp; é\nassistant\n</s><s>[user]\nhi\n", "</s><s>[user]\nhi", 2), 2: ("\n\n", "", 1), 3: ("assistant\nb\nassistant\na\nassistant\na\n", "baa", 3), None: ("system\ns\n", "", 1)}
    assert {k: (r.turns_sha256, r.loss_sha256, r.loss_chars, r.n_turns) for k, r in got.items()} == {k: (sha(a), sha(b), len(b), n) for k, (a, b, n) in want.items()}
    spans = {r.conv_id: r for r in chatformat.format_spans(table).collect()}
    for k, r in spans.items():
        assert "".join(chatformat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == want[k][1] and len(r.formatted) == got[k].formatted_chars


def test_fingerprints(spark, tmp_path):
    import xxhash

    rng = random.Random(5)
    texts = [*ODD, *(words(rng, n) for n in (3, 5, 12, 13, 80, 80, 300))]
    texts.append(texts[-1])

    def winnow(text):
        w = [x for x in re.split("[ \t-\r]+", (text or "").lower()) if x]
        c = [(xxhash.xxh64_intdigest(x.encode(), 42) + 2**63) % 2**64 - 2**63 for x in w]
        c, m = [x % fingerprint._MOD for x in c], fingerprint._MOD
        if not c:
            return []
        if len(c) < 5:
            h = 17
            for x in c:
                h = (h * fingerprint._BASE + x) % m
            g = [h]
        else:
            g = [sum(c[i + j] * pow(fingerprint._BASE, 4 - j, m) % m for j in range(5)) % m for i in range(len(c) - 4)]
        out = []
        for i in range(max(1, len(g) - 7)):
            part = g[i : i + 8]
            best = (min(part), i + max(j for j, x in enumerate(part) if x == min(part)))
            if best not in out:
                out.append(best)
        return out

    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in fingerprint.op7_fingerprint(spark, str(tmp_path)).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1 if i else len(texts) - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r, (a, b, c) = rows[i], (winnow(x) for x in (t, edited, nxt))
        assert r.fingerprint == " ".join(f"{h:x}@{p}" for h, p in a) and r.edited_fingerprint == " ".join(f"{h:x}@{p}" for h, p in b)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like({h for h, _ in a}, {h for h, _ in b})) and r.near_next == pytest.approx(like({h for h, _ in a}, {h for h, _ in c}))


def test_fingerprints_of_short_texts(spark, tmp_path):
    rng = random.Random(15)
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    texts = [*ODD, *(words(rng, n) for n in range(1, 60)), *map(cjk, (2, 7, 23, 500)), "\U0001f600" * 3, "a " * 30 + "y" * 400, words(rng, 20) + cjk(900)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in fingerprint.op7_fingerprint(spark, str(tmp_path)).collect()}
    assert sum(r.near_edited == 0 for r in rows.values()) > 10  # words alone see nothing there
    for i, t in enumerate(texts):
        r, t, nxt = rows[i], t or "", texts[i - 1 if i else len(texts) - 1] or ""
        half = len(t) // 2
        edited, first = t[: len(t) - half] + nxt[:half], t[: len(t) - half]
        assert r.near_edited_whole > 0
        assert (r.char_fingerprint is not None) == (len([x for x in re.split("[ \t-\r]+", first) if x]) < 13)
        if r.char_fingerprint is None:
            assert r.near_edited_whole == r.near_edited
        elif len(t) < fingerprint.SHORT:
            a, b = set(t.lower()), set(edited.lower())
            assert r.near_edited_whole == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_best_fit():
    rng = random.Random(6)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 200))]
        got = packing.best_fit_decreasing(sizes, 50)
        bins, slow = [], 0
        for n in sorted(sizes, reverse=True):  # tightest open window by looking at all
            fit = min((x for x in bins if x >= n), default=None)
            if fit is None:
                slow += 1
                bins.append(50 - n)
            else:
                bins[bins.index(fit)] -= n
        assert len({s for s, _ in got}) == slow
        taken = {}
        for n, (s, o) in sorted(zip(sizes, got, strict=True), key=lambda x: x[1]):
            assert taken.get(s, 0) == o
            taken[s] = o + n
        assert all(x <= 50 for x in taken.values())


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(7)
    special = ["<|endoftext|> it's", "a <|endoftext|> b", "<|endoftext|>" * 3 + "<|endoftext|", " <|endoftext|>\n" * 700]
    texts = [*ODD, *special, *(words(rng, n) for n in (10, 500, 900, 2000)), "dup", "dup"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(documents(spark, texts), block=5).collect()
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    taken = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == taken.get(r.sequence_id, 0)
        taken[r.sequence_id] = r.offset + r.length
    assert max(taken.values()) <= 1024


def test_packing_does_not_depend_on_splits(spark):
    rng = random.Random(9)
    docs = documents(spark, [words(rng, rng.randint(5, 300)) for _ in range(600)])
    few, many = ({r.sequence_id for r in packing.pack(docs.repartition(n)).collect()} for n in (1, 60))
    ids = sum(r.length for r in packing.pack(docs).collect())
    assert len(few) == len(many) == -(-ids // packing.WINDOW)
    assert packing.pack(docs.limit(0)).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    vocab = tokencount.vocabulary("piece_bpe_32k.model")
    whole = Tokenizer(models.Unigram(list(vocab), 0, True))
    rng = random.Random(8)
    texts = [*ODD, "  lead  and trail ", "tab\tnew\nline", *(words(rng, 50) for _ in range(5)), "Zwölf Boxkämpfer, <0x41> </s>"]
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        marked = (t or "").replace(" ", tokencount.BLANK)
        marked = marked if marked.startswith(tokencount.BLANK) or not marked else tokencount.BLANK + marked
        assert got[i] == (len(whole.encode(marked, add_special_tokens=False).ids) if marked else 0), t
    # ties, unknown runs and pieces across words, with a small vocabulary
    tiny = (("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.0), ("▁a", -2.0), ("a▁b", -2.5))
    small, ours = Tokenizer(models.Unigram(list(tiny), 0, False)), tokencount.PieceCounter(tiny)
    for _ in range(200):
        t = "▁" + "".join(rng.choice("abc▁") for _ in range(rng.randint(0, 9)))
        assert ours.count(t) == len(small.encode(t, add_special_tokens=False).ids), t


def test_sharding(spark):
    texts = [*ODD * 20, None]
    docs = documents(spark, texts).withColumnRenamed("text", "body")
    placed = sharding.rendezvous(docs, "doc_id", [1.0] * 5, grow=1.0)
    rows = sharding.slots(placed).collect()
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 5) for r in rows) and any(r.grown_shard == 5 for r in rows)
    again = {r.doc_id: r.shard for r in sharding.rendezvous(docs, "doc_id", [1.0] * 6).collect()}
    assert again == {r.doc_id: r.grown_shard for r in rows}
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    share = {r.shard: r["count"] for r in sharding.rendezvous(ids, "doc_id", [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.7 < share[1] / 4000 < 0.8
    assert sharding.rendezvous(docs.limit(0), "doc_id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(ids, "doc_id", [])


def test_fold(spark):
    rows = spark.createDataFrame([(1,), (None,), (-7,)], "i bigint").select("i", held_out(F.col("i")).alias("h")).collect()
    assert {r.i: r.h for r in rows} == {i: zlib.crc32(str(i).encode() if i is not None else b"") % 3 == 1 for i in (1, None, -7)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts, good, labels = labelled(spark, 120)
    texts += [texts[1], texts[2] + " x", *ODD]
    item = words(random.Random(9), 40)
    texts += [item, words(random.Random(10), 900) + " " + item + "."]
    documents(spark, texts, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    letters = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    grams = lambda t: [int(x) for b in langid._each_gram(t) for x in b]
    seen = {g for i, t in enumerate(texts) if t and zlib.crc32(str(i).encode()) % 3 != 1 for g in grams(t)}
    assert set(kept[0]) == {i for i in letters if 2 * sum(g in seen for g in grams(texts[i])) >= len(grams(texts[i]))} >= set(range(122))
    assert {i for i in range(120) if good[i]} <= set(kept[1])
    assert len({i for i in range(120) if not good[i]} & set(kept[1])) <= 3  # 30 bad ones, few to learn from
    ids = sorted(kept[1])
    parts = brute_components([kept[1][i] for i in ids])
    assert set(kept[2]) == {ids[c] for _, c in parts.values()}
    assert all(not brute_hits(t, [(1, item)])[1] for t in kept[3].values()) and 122 not in kept[2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[3])


def test_near_duplicates_recall_and_whole_sets(spark):
    """Pairs right above the limit: sketches find what whole sets find."""
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        w = words(rng, rng.randint(150, 400)).split()
        other = list(w)
        for at in rng.sample(range(5, len(w) - 5), round(0.028 * len(w))):  # each edit costs five shingles
            other[at] = words(rng, 1)
        texts += [" ".join(w), " ".join(other)]
    exact = brute_components(texts)
    linked = sum(1 for i, (_, c) in exact.items() if c != i)
    docs = documents(spark, texts)
    for k in (neardup.K, None):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k).collect()}
        assert got == exact
    assert 15 <= linked <= 60
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


def read_by_library(source):
    """A brute-force reader of pages with an article, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.blocks = [], [""]

        def handle_starttag(self, tag, attrs):
            if tag == "p" and "p" in self.open:
                self.handle_endtag("p")
            if tag in htmltext._BLOCK:
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "
            elif tag not in htmltext._VOID:
                self.open.append(tag)

        def handle_endtag(self, tag):
            if tag in self.open:
                gone = self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
                del self.open[-len(gone) :]
                if any(t in htmltext._BLOCK for t in gone):
                    self.blocks.append("")

        def handle_data(self, data):
            if "article" in self.open and not any(t in htmltext._SKIP for t in self.open):
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(source or "")
    reader.close()
    return "\n".join(x for b in reader.blocks if (x := re.sub(r"\s+", " ", b).strip()))


def test_html_against_a_brute_force_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    wanted = {r.page_id: read_by_library(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    assert got == wanted and sum(map(len, got.values())) > 10_000


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<article><p title=it's>Hello there</p><p>It isn't lost</p></article>", "Hello there\nIt isn't lost"),
        ("<article><div class='article-header'><h1>Big title</h1></div><p>t</p></article>", "Big title\nt"),
        ("<article><div class='share-prices'><p>up</p></div><p>see <a class='related'>this</a></p></article>", "up\nsee this"),
        ("<article><table class='ad-spend'><tr><td>5</table><p><math>x</math> <label>y</label></article>", "5\nx y"),
        ("<article><div class='cookie-banner'>ok?</div><div id=comments>mine</div><div class=sidebar-2>s</div><p>t</p></article>", "t"),
        ("<article><p>a &am", "a &am"),
        ("<article><p>a < b <3 <!-- > --> c</ >d</article>", "a < b <3 cd"),
        ("<main><h1>T</h1><div class=lead>lead</div><div class=body>body</div></main>", "T\nlead\nbody"),
    ],
)
def test_html_pages(source, text):
    assert htmltext.extract(source, None) == text


@pytest.mark.parametrize(
    "source",
    ["<a " * 10**5, "<b>" * 10**5 + "</i>" * 10**5, "<" * 10**5, "<b>" * 10**5 + "<hr>" * 10**5, "<script>" + "</script " * 10**5, '<a x=">" ' * 10**5, "<ul>" + "<b>" * 10**4 + "<li></li>" * 10**4, "<h2>a</h2><p>b</p>" * 10**4],
)
def test_html_takes_linear_time(source):
    import time

    began = time.process_time()
    htmltext.extract(source, None)
    whole = htmltext.skeleton(htmltext.parse(source))
    htmltext._merged(whole, htmltext.skeleton(htmltext.parse(source[: len(source) // 2])))
    assert time.process_time() - began < 20


def test_html_by_the_wrapper(spark):
    """The wrapper decides: pages read with their host's wrapper differ from pages read alone."""
    rng = random.Random(3)
    line = lambda n=9: words(rng, n)
    plain, marked, wanted = [], [], {}
    for i in range(12):
        links = "".join(f"<div><a href='/{j}'>{line(2)}</a></div>" for j in range(5))
        title, first, second = line(), line(40), line(30)
        plain.append((i, f"http://plain.example/{i}", f"<body class=p{i}><div><p>Our site says hello to you</p></div><div class=x>{links}</div><div class=y><h1>{title}</h1><div><p>{first}<p>{second}</div></div><div>All rights kept</div>"))
        wanted[i] = "\n".join((title, first, second))
        short = i % 4 == 0  # an article far shorter than what is beside it
        body = line(3) if short else f"{first} {second} {first}"
        marked.append((100 + i, f"http://marked.example/{i}", f"<article><p>{body}</p></article><div>{line(20)}</div>"))
        wanted[100 + i] = body
    pages = spark.createDataFrame([*plain, *marked], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in htmltext.main_text(pages).collect()} == wanted
    alone = {i: htmltext.extract(source, None) for i, _, source in [*plain, *marked]}
    assert all(alone[i] != wanted[i] for i in range(12)) and alone[100] != wanted[100]
    # shares of a host are merged to the same decisions
    shares = {r.host: r.main for r in htmltext.wrappers(pages).collect()}
    htmltext.SHARE_PAGES, was = 3, htmltext.SHARE_PAGES
    try:
        assert {r.host: r.main for r in htmltext.wrappers(pages).collect()} == shares
    finally:
        htmltext.SHARE_PAGES = was


def test_token_counts_of_unbroken_text_in_little_memory():
    import tracemalloc

    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1_000_000))
    ours = tokencount.counter("piece_bpe_32k.model")
    tracemalloc.start()
    n = ours.count(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= len(text) and peak < 12 * len(text)  # copies of the text itself, 2 bytes a character
    part = text[:3000]
    from tokenizers import Tokenizer, models

    whole = Tokenizer(models.Unigram(list(tokencount.vocabulary("piece_bpe_32k.model")), 0, True))
    assert ours.count(part) == len(whole.encode(tokencount.BLANK + part, add_special_tokens=False).ids)


def test_benchmark_blocks_and_bound(spark):
    rng = random.Random(6)
    items = [(f"i{j}", words(rng, rng.choice([3, 12, 13, 30]))) for j in range(40)] + [("x", None), (None, "a b c")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = [decontam.words(" ".join(rng.choice(items[:40])[1] for _ in range(3)) + " " + words(rng, 5)) for _ in range(60)]
    one, many = decontam.automata(bench), decontam.automata(bench, block_words=50)
    assert len(one) == 1 and len(many) > 5
    for ws in docs:
        spans, found = one[0].scan(ws)
        got = [a.scan(ws) for a in many]
        assert decontam._merged([g[0] for g in got]) == spans and set().union(*(g[1] for g in got)) == found and found
    with pytest.raises(ValueError):
        decontam.automata(bench, most_words=100)


def brute_shard(key, weights):
    import struct

    import xxhash

    digest = xxhash.xxh64_digest(str("null" if key is None else key).encode(), seed=42)[::-1]
    best = []
    for i, w in enumerate(weights):
        seed = xxhash.xxh64_intdigest(digest, seed=42)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed) >> 11) + 0.5) / 2**53
        best.append((-w / np.log(u), -i))
    return -max(best)[1]


def test_sharding_winner_and_query(spark, tmp_path):
    weights = [1.0, 2.5, 0.5, 1.0]
    keys = [*range(200), None]
    rows = sharding.rendezvous(spark.createDataFrame([(k,) for k in keys], "k long"), "k", weights).collect()
    assert {r.k: r.shard for r in rows} == {k: brute_shard(k, weights) for k in keys}
    texts = [*ODD, *(words(random.Random(1), 9) for _ in range(80))]
    own = [(i, t) for i, t in enumerate(texts)] + [(5, "same")] * 40 + [(None, None)] * 30
    spark.createDataFrame(own, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op10_sharding(spark, str(tmp_path)).collect()
    size = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, *size(t)) for i, t in own), key=str)
    assert all(r.shard == brute_shard(r.doc_id, [1.0] * 24) and r.grown_shard == brute_shard(r.doc_id, [1.0] * 25) for r in got)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert sharding.op10_sharding(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("broadcast", [-1, 10**6])
def test_fingerprint_neighbours_of_odd_ids(spark, tmp_path, monkeypatch, broadcast):
    """Clustered, repeated and missing ids, in many small groups, against a sort."""
    monkeypatch.setattr(fingerprint, "SEGMENTS", 70)
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 1)
    monkeypatch.setattr("strandweave.session.BROADCAST_ROWS", broadcast)
    rng = random.Random(2)
    ids = [*range(40), *(10**12 + i * i for i in range(60)), *[777] * 80, *[None] * 60, -5, -(10**9)]
    own = [(i, words(rng, rng.randint(0, 12))) for i in ids]
    spark.createDataFrame(own, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    order = sorted(own, key=lambda r: (r[0] is None, -(r[0] or 0), md5(r[1])))
    wanted = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        wanted.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprint.op7_fingerprint(spark, str(tmp_path)).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_unknown_languages_go(spark):
    rng = random.Random(12)
    texts = [words(rng, 60) for _ in range(80)]
    docs = documents(spark, texts)
    model = langid.train(docs)
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве", "人人生而自由在尊严和权利上一律平等", None, "", "12 34"]
    kept = langid.keep_known(documents(spark, texts + foreign), model)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80)) and kept.columns == docs.columns
    # many dirty language values: the most frequent ones are learned
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("lang")))
    was, langid.MOST_LANGS = langid.MOST_LANGS, 2
    try:
        assert langid.train(dirty).langs == ("de", "en")
    finally:
        langid.MOST_LANGS = was


def test_quality_with_repeated_ids(spark):
    rng = random.Random(13)
    texts = [words(rng, 60) if i % 2 else "!!! " * 40 for i in range(60)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    once, often = quality.train(docs, labels), quality.train(docs.unionByName(docs).unionByName(docs), labels)
    assert np.array_equal(once.threshold, often.threshold) and np.array_equal(once.value, often.value)


def test_empty_tables(spark, tmp_path):
    from strandweave.llm.registry import QUERIES

    schemas = {
        "documents": DOCS, "labels": "doc_id bigint, quality int, toxic int", "pages": "page_id bigint, url string, html string",
        "benchmark": "item_id bigint, text string", "conversations": "conv_id bigint, turn bigint, role string, text string",
    }
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name.startswith("op6") else 0), name
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_hand_on_other_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    texts = [words(rng, 120) for _ in range(50)] + [None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None), (3, texts[3], "en", "s", 1), (3, texts[4] + " more words here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.selectExpr("*", *(f"'x' as {c}" for c in ("shard", "kept", "score", "group", "sketch", "text_key", "cid", "lang_pred", "one")))
    spark.createDataFrame([(i, 1) for i in range(50)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(rng, 30))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.text for r in docs.collect()} >= {t for t in texts[:3]} and docs.where("kept <> 'x'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
