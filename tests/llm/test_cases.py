"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm import _common, minhash_dedup, pii, queries as q, substring_dedup
from marlstone.llm.chat_format import fold_events, format_chats, loss_text, parse
from marlstone.llm.decontaminate import Automaton, drop_contaminated, find_contamination, judge, pieces_of, scan
from marlstone.llm.exact_dedup import CHUNK, compose, exact_dedup, fingerprint
from marlstone.llm.html_extract import extract_main_text
from marlstone.llm.line_dedup import drop_boilerplate, line_dedup
from marlstone.llm.minhash_dedup import drop_near_duplicates, near_duplicates
from marlstone.llm.pii import KINDS, base_spans, find_personal_data
from marlstone.llm.sentencepiece_codec import Codec, decode_column, encode_documents
from marlstone.llm.substring_dedup import repeated_passages
from marlstone.llm.toxicity import drop_toxic, toxicity

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, score double, key string, id long, value long, a long"


def table(spark, rows):
    """Documents with columns whose names clash with what operators call theirs."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), None, "r", 0.5, "k", 7, 8, 9) for i, t, s in rows], EXTRA)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = words(1, 60_000)
    rows = [(1, None, "s"), (2, "", "s"), (3, " \t\n", None), (4, "same text here", "s"), (4, "same text here", "s"), (None, "same  text\nhere", "s"), (5, "same text  here", None), (6, long, "s"), (7, long + " end", "s"), (None, None, None)]
    return table(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, None, 1), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


def test_exact_dedup_cases(odd):
    got = {(r.doc_id, r.text_sha256[:8]): r for r in exact_dedup(odd).collect()}
    one = got[4, hashlib.sha256(b"same text here").hexdigest()[:8]]
    assert (one.keep_id, one.group_size, one.kept) == (4, 4, True)
    assert got[5, one.text_sha256[:8]].keep_id == 4 and not got[5, one.text_sha256[:8]].kept
    empty = hashlib.sha256(b"").hexdigest()[:8]
    assert got[1, empty].kept and not got[2, empty].kept and got[None, empty].keep_id == 1


def test_huge_texts_are_hashed_in_parts_alike(odd):
    whole = sorted(map(str, exact_dedup(odd).collect()))
    assert sorted(map(str, exact_dedup(odd, piece_chars=1000, huge_chars=20).collect())) == whole


def test_fingerprints_compose():
    raw = random.Random(5).randbytes(3 * CHUNK + 17)
    for cut in (0, 1, CHUNK, 2 * CHUNK + 5, len(raw)):
        assert compose(fingerprint(raw[:cut]), fingerprint(raw[cut:]), len(raw) - cut) == fingerprint(raw)
    assert fingerprint(b"\0") != fingerprint(b"\0\0")


def test_line_dedup_cases(spark, odd):
    assert line_dedup(odd).count() == odd.count() and line_dedup(odd).columns == odd.columns
    rows = [(i, f"  menu \nown {i}\n\nmenu", "a") for i in range(6)] + [(9, "menu", "b"), (10, None, "a"), (11, "menu\nmenu", "a")]
    got = {r.row.doc_id: r for r in drop_boilerplate(table(spark, rows)).collect()}
    assert got[0].text == "own 0\n" and got[0].n_dropped == 2
    assert got[9].text == "menu" and got[10].text is None and got[11].text == ""
    assert {r.doc_id: r.n_chars for r in line_dedup(table(spark, rows)).collect()}[0] == 6


def test_copies_are_no_evidence_against_their_lines(spark):
    rows = [(i, "a page\nmirrored", "a") for i in range(50)] + [(100 + i, "\n".join(f"line {k}" if k != i else f"edited {k}" for k in range(40)), "b") for i in range(30)]
    assert drop_boilerplate(table(spark, rows)).filter("n_dropped > 2").count() == 0
    assert drop_boilerplate(table(spark, rows).limit(0)).count() == 0


def test_empty_tables(odd):
    assert [f(odd.limit(0)).count() for f in (exact_dedup, near_duplicates, line_dedup, drop_near_duplicates)] == [0] * 4


def test_near_duplicate_cases(odd):
    got = sorted(map(tuple, near_duplicates(odd).collect()), key=str)
    by = {(r[0], r[1]): r for r in got}
    assert by[6, 59996][2:] == (6, True) and by[7, 59997][2:] == (6, False)
    assert by[4, 1][2:] == (4, True) and by[5, 1][2:] == (4, False) and by[1, 0][2:] == (1, True) and by[3, 0][2:] == (3, True)
    assert (None, 1, 4, False) in got or (None, 1, None, False) in got
    assert drop_near_duplicates(odd).columns == odd.columns
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(odd).collect()) == ["1", "2", "3", "4", "4", "6", "None", "None"]


def test_repeated_ids_with_different_texts(spark):
    """Near copies of either text of id 1 are linked by it, and passages of either are found."""
    a, b = words(11, 120), words(12, 120)
    d = table(spark, [(1, a, "s"), (1, b, "s"), (2, a + " end", "s"), (3, b + " end", "s"), (4, words(13, 120), "s")])
    assert {r.component_id for r in near_duplicates(d).collect() if r.doc_id != 4} == {1}
    got = repeated_passages(table(spark, [(1, a, "s"), (1, b, "s"), (2, words(14, 30) + " " + a, "s"), (3, words(15, 30) + " " + b, "s")])).collect()
    assert {x for r in got for x in (r.doc_id, r.match_id)} == {1, 2, 3}


def test_hot_buckets_are_compared_in_blocks(spark):
    """Versions of one text that drift: neighbours are linked, far ones are not, and one bucket holds many of them; against all pairs."""
    r, base = random.Random(8), words(21, 200).split()
    rows = []
    for i in range(60):
        if i % 3 == 0:
            base = base[:]
            base[r.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(base), "s"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t, _ in rows}
    top = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((top[i], top[j]))
                top = [x if t == y else t for t in top]
    got = {x.doc_id: x.component_id for x in near_duplicates(table(spark, rows), block=4).collect()}
    assert got == dict(enumerate(top))


def test_documents_outside_open_buckets_are_not_shuffled_to_the_blocks(spark, monkeypatch):
    """The bytes that the block step shuffles follow its open members, however many documents there are besides; repeated rows stay one leader."""
    versions = words(31, 200).split()
    family = []
    for i in range(40):  # every other version lies far from its neighbours, so the bucket stays open
        own = versions[:]
        for k in range(0, 200, 14):
            own[(k + i % 4) % 200] = f"v{i % 8}x{k}"
        family.append((i, " ".join([*own, f"end{i}"]), "s"))

    def shuffled():
        time.sleep(0.3)
        spark.range(1).count()  # brings the summary up to date
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    blocks = []

    def measured(df, label):
        before = shuffled() if label == "block-links" else 0
        out = _common.save(df, label)
        if label == "block-links":
            blocks.append(shuffled() - before)
        return out

    monkeypatch.setattr(minhash_dedup, "save", measured)
    got = []
    for others in (0, 3000):
        rows = family * 2 + [(1000 + i, words(5000 + i, 12), "s") for i in range(others)]
        out = near_duplicates(table(spark, rows), block=8).collect()
        got.append({x.doc_id: x.component_id for x in out if x.doc_id < 1000})
        assert len(out) == len(rows) and all(x.component_id == x.doc_id for x in out if x.doc_id >= 1000)
    assert got[0] == got[1] and len(got[0]) == 40
    assert len(blocks) == 2 and blocks[1] < 1.2 * blocks[0] + 100_000


def test_decontamination_cases(spark, odd):
    bench = spark.createDataFrame([(1, "Same, TEXT here"), (None, "same"), (2, None), (3, ""), (1, "same text")], "item_id long, text string")
    got = {r.row.doc_id: r for r in judge(find_contamination(odd, bench)).collect() if r.row.doc_id}
    assert (got[4].n_words, got[4].n_hit, got[4].items, got[4].contaminated) == (3, 3, ["", "1"], True)
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated) == (0, 0, False)
    assert got[5].hits[0].start == 0 and got[5].hits[0].end == 15
    assert drop_contaminated(odd, bench).columns == odd.columns and drop_contaminated(odd, bench).count() == 6
    assert drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    many = find_contamination(odd, bench, max_bytes=3000)
    key = lambda d: sorted(str((r.row.doc_id, r.n_words, r.hits, r["items"])) for r in d.collect())
    assert key(many) == key(find_contamination(odd, bench))


def test_long_items_are_cut_with_overlap(spark, odd):
    """A benchmark item of 60,000 words, dealt over several automata, marks what one automaton marks: all of its own text."""
    bench = spark.createDataFrame([(None, words(1, 60_000)), (None, words(3, 50))], "item_id long, text string")
    for most in (250_000_000, 20_000_000):
        got = {r.row.doc_id: r for r in find_contamination(odd, bench, max_bytes=most).collect()}
        assert [(h.first, h.last) for h in got[6].hits] == [(0, 59_999)] and [(h.first, h.last) for h in got[7].hits] == [(0, 59_999)] and got[4].hits == []
    assert find_contamination(odd.limit(0), bench).count() == 0
    assert [len(p) for p in pieces_of([b"w"] * 30, 13, 9)] == [21, 21] and pieces_of([b"w"] * 5, 13, 9) == [[b"w"] * 5] and pieces_of([], 13) == []


def test_scan_against_brute_force():
    r = random.Random(2)
    for _ in range(1500):
        kinds = [b"a", b"b", b"c", b"dd"]
        items = [(str(i), b" ".join(r.choice(kinds[:3]) for _ in range(r.randint(1, 9))).decode()) for i in range(r.randint(0, 3))]
        doc = [r.choice(kinds) for _ in range(r.randint(0, 25))]
        n, hits, ids = scan(b" ".join(doc), None, Automaton(items, 4))
        want, named = set(), set()
        for i, t in items:
            w = t.encode().split()
            for g in (w[k : k + 4] for k in range(max(1, len(w) - 3))):
                for p in range(len(doc) - len(g) + 1):
                    if doc[p : p + len(g)] == g:
                        want |= set(range(p, p + len(g)))
                        named.add(i)
        assert n == len(doc) and {x for a, b, _, _ in hits for x in range(a, b + 1)} == want and set(ids) == named


def test_toxicity_cases(odd, labels):
    assert toxicity(odd, labels).count() == odd.count()
    assert toxicity(odd, labels.limit(0)).filter("score != 0").count() == 0
    assert drop_toxic(odd, labels).columns == odd.columns
    assert toxicity(odd.limit(0), labels).count() == 0
    held = {r.doc_id: r.held_out for r in toxicity(odd, labels).collect()}
    assert held[5] == (zlib.crc32(b"5") % 3 == 1) and held[None] is False


def test_saved_tables_are_removed(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(_common, "shared_dir", lambda spark: str(tmp_path))
    assert _common.save(spark.range(3), "some").count() == 3 and len(os.listdir(tmp_path)) == 1
    _common.remove_saved(spark)
    assert os.listdir(tmp_path) == []


def test_added_spans_against_brute_force(spark):
    """Spans found by context, against a plain scoring of the same mentions; contexts are mixed, shared by kinds and too weak by turns."""
    r = random.Random(12)
    make = {
        1: lambda: f"user{r.randrange(99)}@mail.example.com", 2: lambda: f"10.0.{r.randrange(9)}.{r.randrange(99)}", 4: lambda: f"+49 30 {r.randrange(10**6, 10**7)}",
        0: lambda: r.choice([f"user{r.randrange(9)}{r.randrange(9)}@intranet", f"(030) 555-{r.randrange(1000, 1020)}", f"ID{r.randrange(10**6, 10**7)}"]),
    }
    before = {1: ["please contact", "write to"], 2: ["server at"], 4: ["call now", "the number"], 0: ["please contact", "call now", "the number", "invoice no"]}
    said = lambda k: f"{r.choice(before[k if r.random() < 0.95 else 4])} {make[k]()} {r.choice(['today', 'please', 'soon', 'twice', 'again'])}"
    rows = [(i, " and ".join(said(r.choice([1, 2, 4, 4, 1, 0])) for _ in range(3)), "s") for i in range(150)]
    edges, found = {}, {}
    for i, t, _ in rows:
        base = base_spans(t)
        for kind, a, b in base + [("", *c) for c in pii.candidates(t, base)]:
            for c in pii.contexts(t, a, b):
                edges[c, t[a:b]] = max(edges.get((c, t[a:b]), ""), kind)
                found.setdefault((i, a, b, kind), []).append(c)
    n, seeds, support = {}, {}, {}
    for (c, _), kind in edges.items():
        n[c] = n.get(c, 0) + 1
        if kind:
            seeds[c] = seeds.get(c, 0) + 1
            support[c, kind] = support.get((c, kind), 0) + 1
    support = {k: v for k, v in support.items() if seeds[k[0]] >= pii.MIN_SUPPORT}
    damped = lambda k, mass: mass / n[k[0]] * (1 - 1 / (3 * support[k]))
    score = {k: damped(k, v) for k, v in support.items()}
    while True:
        belief = {}
        for (c, v), kind in edges.items():
            for (c2, kind2), s in score.items():
                if not kind and c2 == c:
                    belief[v, kind2] = max(belief.get((v, kind2), 0), s)
        new = {k: damped(k, support[k] + sum(belief.get((v, k[1]), 0) for (c, v), kind in edges.items() if c == k[0] and not kind)) for k in support}
        moved, score = max(abs(new[k] - score[k]) for k in new), new
        if moved <= pii.SETTLED:
            break
    strong = {}
    for (c, kind), s in score.items():
        if s >= pii.MIN_SCORE and support[c, kind] >= pii.MIN_SUPPORT:
            strong[c] = max(strong.get(c, (0, "")), (s, kind))
    want = {(i, a, b, kind or max(strong[c] for c in cs if c in strong)[1]) for (i, a, b, kind), cs in found.items() if kind or any(c in strong for c in cs)}
    got = {(x.doc_id, s.start, s.end, KINDS[s.kind - 1]) for x in find_personal_data(table(spark, rows)).collect() for s in x.spans}
    assert got == want
    assert {True, False} == {any(c in strong for c in cs) for (*_, kind), cs in found.items() if not kind}


def test_personal_data_cases(odd):
    assert find_personal_data(odd).count() == odd.count()
    assert find_personal_data(odd.limit(0)).count() == 0


def test_base_spans():
    t = "mail a.b@mail.example.com, not a@b; 1.2.3.256 but 10.0.0.1; 4111 1111 1111 1111 x 4111111111111112; +1 (743) 555-3824! +12"
    got = [(k, t[a:b]) for k, a, b in base_spans(t)]
    assert got == [("email", "a.b@mail.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]


def naive_spans(text):
    """The base patterns as they are written, one after the other."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_address_parts_of_any_length():
    for t in ("0" * 5000 + "1.0.0.1", "9" * 5000 + ".1.1.1", "1.2.3." + "0" * 5000):
        got = base_spans(t)
        assert ("ip" in [k for k, *_ in got]) == (t[0] != "9")


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(3)
    parts = ["@", ".", "a", "b-", "%", "+1", "0", "25", "256", " ", "(", ")", "-", "4111111111111111", "1.2.3.4", "x@y.z", "é", "+49 (30) 123-4567"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert base_spans(t) == naive_spans(t), t


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to contact address user{i}@mail.example.com before noon", "s") for i in range(30)]
    rows += [(100 + i, f"please write to contact address user{i}9999@intranet before noon", "s") for i in range(2)]
    got = {r.doc_id: r for r in find_personal_data(table(spark, rows)).collect()}
    assert len(got[0].base) == 1 and len(got[0].spans) == 1
    assert got[100].base == [] and [(s.kind, s.start) for s in got[100].spans] == [(1, 32)]


def test_contexts_find_numbers_in_groups(spark):
    """Three seeds suffice; the unseen number is written in groups that no base pattern takes; a word of 200 letters is a context like any other."""
    odd = "q" * 200
    rows = [(i, f"please call {odd} +49 30 12345{i:02} before noon", "s") for i in range(12, 15)] + [(100, f"please call {odd} (030) 555-0199 before noon", "s"), (101, f"room 555 0199 {odd}", "s")]
    got = {r.doc_id: r for r in find_personal_data(table(spark, rows)).collect()}
    assert got[100].base == [] and [(s.kind, rows[3][1][s.start : s.end]) for s in got[100].spans] == [(4, "(030) 555-0199")]
    assert got[101].spans == []


def test_pages_cases(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<p>two  <b>bold</b>&lt;</article><div id=comments><p>c</div><footer>f</footer>"
    bare = [(i, "http://h.example/x", f"<body><div><p>the same notice stands on every page of the host</p></div><div><p>own words of page number {i}</p></div>") for i in range(5)]
    rows = [(100, "http://x.example/", page), (101, None, None), (102, "u", ""), *bare]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == "A & B\none\ntwo bold<" and got[101] == "" and got[102] == ""
    assert got[0] == "own words of page number 0"
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", [b"k"]) for r in rows], "page_id long, url string, html string, text string, keys array<binary>")


def test_pages_keep_what_markup_does_not_name(spark):
    mirror = "<body><div>all three mirrors of this page carry the very same text and no markup</div></body>"
    rows = [(i, f"http://m.example/{i}", mirror) for i in range(3)]
    rows += [(3, "http://a.example/", "<main><div class='notice-board-history'>a history of notice boards</div></main>")]
    rows += [(4, "http://b.example/", "<article><h1>T</h1><section class='related-work'>prior papers</section><div class='related'>more links</div></article>")]
    rows += [(5, "http://c.example/", "<div class=post>first half</div><div>second half</div><div class='site-footer'>f</div>")]
    rows += [(6, "http://d.example/", "<main><h1>Title</h1><article><p>body</article></main><div>loose</div>"), (6, "http://d.example/", "<article>same id</article>")]
    got = [(r.page_id, r.text) for r in extract_main_text(pages_of(spark, rows)).collect()]
    same = "all three mirrors of this page carry the very same text and no markup"
    assert sorted(got) == [(0, same), (1, same), (2, same), (3, "a history of notice boards"), (4, "T\nprior papers"), (5, "first half\nsecond half"), (6, "Title\nbody"), (6, "same id")]


def test_very_long_pages(spark):
    long = "<p>" + words(5, 100_000) + "</p>" * 3 + "<div>" * 5000
    got = extract_main_text(pages_of(spark, [(1, None, "<article>" + long), (2, None, long)])).collect()
    assert [r.text for r in got] == [words(5, 100_000)] * 2 and extract_main_text(pages_of(spark, [(1, None, None)])).first().n_chars == 0


def test_repeated_substrings_against_brute_force(spark):
    """Pages without markup: what eight tokens in a row, on three distinct pages and a share of the host, cover goes; all else stays."""
    r = random.Random(6)
    runs = [words(i, 12) for i in range(4)] + ["short menu", "one two three"]
    rows = []
    for i in range(40):
        blocks = [words(100 + i, 9)] + [f"{words(200 + i, 3)} {x} {words(300 + i, 2)}" if len(x) > 20 else x for x in r.sample(runs, 3)]
        rows.append((i, f"http://h{i % 3}.example/", "".join(f"<div>{b}</div>" for b in blocks), blocks))
    rows += [(90 + i, "http://h0.example/", rows[0][2], rows[0][3]) for i in range(4)]
    where, hosts = {}, {}
    grams = lambda t: [tuple(t[k : k + 8]) for k in range(max(1, len(t) - 7))]
    for _, url, _, blocks in rows:
        hosts.setdefault(url, set()).add(tuple(blocks))
        for b in blocks:
            for g in grams(b.split()):
                where.setdefault((url, g), set()).add(tuple(blocks))
    got = {x.page_id: x.text for x in extract_main_text(pages_of(spark, [x[:3] for x in rows]), min_share=0.2).collect()}
    for i, url, _, blocks in rows:
        lines = []
        for b in blocks:
            t = b.split()
            out = {k + j for k, g in enumerate(grams(t)) for j in range(8) if len(where[url, g]) >= 3 and len(where[url, g]) > 0.2 * len(hosts[url])}
            lines.append(" ".join(x for k, x in enumerate(t) if k not in out))
        assert got[i] == "\n".join(filter(None, lines)), i


def test_chat_cases(spark):
    rows = [(1, 0, None, "</s>[INST] & <|end|>&lt;"), (1, 1, "assistant", None), (1, 1, "assistant", "x\ny"), (None, 5, "role\nwith", "t"), (2, 0, "user", "")]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("", "</s>[INST] & <|end|>&lt;"), ("assistant", ""), ("assistant", "x\ny")]
    assert got[1].loss == "x\ny" and [tuple(t) for t in got[None].turns] == [("role\nwith", "t")] and got[2].loss == ""


def test_tied_turns_are_ordered_by_their_own_text(spark):
    rows = [(1, 0, "user", "5 after the sign"), (1, 0, "user", "<sign"), (1, 0, "user", "[sign"), (1, 0, "a&b", "role first"), (1, 0, "user", "5 after the sign")]
    out = format_chats(spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, message_id long, log string"))
    got = out.select(parse(F.col("formatted")).alias("t")).first().t
    assert [tuple(x) for x in got] == sorted(r[2:] for r in rows)
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_very_long_turns(spark):
    long = "x<[&\n" * 200_000
    out = format_chats(spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "assistant", "end")], "conv_id long, turn long, role string, text string"))
    got = out.select(parse(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert got.t[0].text == long and got.loss == long + "end"


def test_events_fold(spark):
    log = [(1, "m", 1, "message", "assistant", "Hel"), (1, "m", 2, "delta", "assistant", "lo"), (1, "m", 4, "regenerate", "assistant", "Good "), (1, "m", 5, "delta", "assistant", "day"), (1, "n", 3, "delta", "user", "only "), (1, "n", 6, "delta", "user", "deltas")]
    got = fold_events(spark.createDataFrame(log, "conv_id long, message_id string, seq long, kind string, role string, text string")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in got] == [(1, "assistant", "Good day"), (3, "user", "only deltas")]


@pytest.fixture(scope="module")
def codec():
    return Codec.load(q.VOCABULARY)


def test_sentencepiece_cases(spark, odd, codec):
    out = encode_documents(odd, codec)
    got = out.collect()
    assert len(got) == odd.count() and all(r.intact for r in got if r.ids is not None)
    texts = {r[0] for r in out.select(decode_column(codec, spark)("ids")).collect()}
    assert texts == {r.text for r in odd.select("text").collect()}
    assert encode_documents(odd.limit(0), codec).count() == 0


def best_score(codec, word):
    best = [0.0]
    for i in range(1, len(word) + 1):
        best.append(max([best[i - 1] + codec.penalty] + [best[j] + codec.scores[word[j:i]][0] for j in range(i) if word[j:i] in codec.scores]))
    return best[-1]


def test_segmentation_is_the_best_one(codec):
    score = {i: s for s, i in codec.scores.values()}
    r = random.Random(4)
    words_ = ["".join(r.choice("thengisarécü .,1") for _ in range(r.randint(1, 12))) for _ in range(400)]
    for w, ids in codec.encode_words(set(words_)).items():
        w, got, k = w.replace(" ", "▁"), 0.0, 0
        for i in ids:
            got += score.get(i, 0.0)
            k += i not in score
        spelled = sum(len(c.encode()) for c in w if c not in codec.scores)
        assert k == spelled and got + codec.penalty * sum(c not in codec.scores for c in w) == best_score(codec, w)


def test_passages(spark, odd):
    assert repeated_passages(odd.limit(0)).count() == 0
    p = words(77, 60)
    rows = [(i, words(i, 80) + " " + p + " " + words(100 + i, 50), "s") for i in range(5)] + [(50, words(50, 300), "s"), (51, words(50, 300), "s"), (60, "short", "s"), (None, p, "s"), (61, None, "s")]
    got = repeated_passages(table(spark, rows)).collect()
    found = {r.doc_id for r in got if not r.whole} | {r.match_id for r in got if not r.whole}
    assert found == set(range(5))
    assert all(r.first_word == r.match_first == 80 and r.last_word == 139 for r in got if not r.whole)
    assert [(r.doc_id, r.match_id) for r in got if r.whole] == [(51, 50)]


def test_passages_around_a_common_template_against_brute_force(spark):
    """The shortest text shares only a template of 40 words; passages that hold more of it than that are found in all others, at every place."""
    r, rows = random.Random(10), []
    template = words(500, 40)
    for g in range(30):  # each pair has ten words of its own beside the template
        left, right = words(600 + g, 10), words(700 + g, 10)
        passage = f"{left} {template}" if g % 3 == 0 else f"{template} {right}" if g % 3 == 1 else f"{words(600 + g, 5)} {template} {words(700 + g, 5)}"
        rows += [(10 * g + k, f"{words(1000 + 10 * g + k, r.randint(30, 90))} {passage} {words(2000 + 10 * g + k, r.randint(30, 90))}", "s") for k in range(2)]
    rows += [(1, f"{words(3000, 8)} {template} {words(3001, 8)}", "s"), (2, f"{words(3002, 5)} {template} {words(600, 10)} x", "s")]
    twice = words(800, 55)
    rows += [(3, f"{twice} a b {twice} c {twice}", "s"), (4, words(801, 300) + " " + twice, "s")]
    got = repeated_passages(table(spark, rows)).collect()
    inside, groups = {}, {}
    for x in got:
        for i, a, b in ((x.doc_id, x.first_word, x.last_word), (x.match_id, x.match_first, x.match_last)):
            inside.setdefault(i, set()).update(range(a, b + 1))
        one = groups.get(x.doc_id, {x.doc_id}) | groups.get(x.match_id, {x.match_id})
        groups.update({i: one for i in one})
    where = {}
    for i, text, _ in rows:
        w = text.split()
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add((i, k))
    shared = [at for at in where.values() if len({i for i, _ in at}) > 1]
    assert len(shared) > 30
    for at in shared:
        assert len({frozenset(groups.get(i, {i})) for i, _ in at}) == 1, at
        assert all(inside[i] >= set(range(k, k + 50)) for i, k in at), at


def test_near_copies_that_the_elected_text_does_not_hold(spark, monkeypatch):
    """The shortest text shares only a template of 30 words; near copies without 50 equal words in a row are found among the others, in one block or several."""
    template, rows, pairs = words(500, 30), [(1, f"{words(3000, 12)} {words(500, 30)} {words(3001, 12)}", "s")], []
    for g in range(30):  # 50 words, of which one is changed near the template: all other words of the longest run but two are the template's
        own, at = words(600 + g, 20).split(), 2 if g % 2 else 17
        for k, x in ((0, own), (1, own[:at] + ["other"] + own[at + 1 :])):
            passage = f"{template} {' '.join(x)}" if g % 2 else f"{' '.join(x)} {template}"
            rows.append((10 * g + 100 + k, f"{words(1000 + 10 * g + k, 40)} {passage} {words(2000 + 10 * g + k, 40)}", "s"))
        pairs.append((10 * g + 100, 10 * g + 101))
    for part in (512, 16):
        monkeypatch.setattr(substring_dedup, "PART", part)
        got = {frozenset((x.doc_id, x.match_id)): x for x in repeated_passages(table(spark, rows)).collect()}
        assert all(frozenset(p) in got for p in pairs)
        assert all(x.similarity >= 0.8 and x.last_word - x.first_word >= 49 and x.match_last - x.match_first >= 49 for x in got.values())
        assert all(max(p) - min(p) == 1 for p in got)


def test_runs_that_a_passage_holds_for_certain():
    """50 words with one word changed keep a similarity of 0.8, and 21 equal tokens in a row wherever it is."""
    from marlstone.llm.substring_dedup import least_run

    assert least_run(46, 4, 5) == 21 and least_run(46, 1, 1) == 46
    w = words(900, 50).split()
    for at in range(5, 45):
        same = _common.shingle_hashes(" ".join(w).encode()) == _common.shingle_hashes(" ".join(w[:at] + ["other"] + w[at + 1 :]).encode())
        assert max(len(x) for x in "".join("x" if s else " " for s in same).split()) >= 21


def test_a_group_of_windows_meets_its_elected_text_in_parts_and_without_a_join_for_its_size(spark, monkeypatch):
    """Pairs grow with the members of a group and not with their square, whether a group is larger than one part or not."""
    monkeypatch.setattr(substring_dedup, "PART", 16)
    for n in (10, 200, 400):
        rows = [(1, i, 100 + i, 5, 2, 3) for i in range(n)] + [(2, i, 100 + i, 50 + k, 2, 3) for i in (3, 4) for k in range(40)] + [(3, 7, 107, 1, 2, 3)]
        windows = spark.createDataFrame(rows, substring_dedup._WINDOW)
        members, pairs = substring_dedup._meetings(windows, "parts")
        got = {(x.a, x.b): len(x.hits) for x in pairs.collect()}
        assert got == {(0, i): 1 for i in range(1, n)} | {(3, 4): 40} and members.count() == n + 80
        assert "LeftOuter" not in pairs._jdf.queryExecution().optimizedPlan().toString()
