"""The registered queries over a written folder of tables: every contract column against brute force, and those with SQL against it."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_documents import PII_BASE, SECRET_BASE, brute_classes, brute_hits, finditer, prose, reference_fingerprint, unlike
from test_pages import SHELL
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import packing, tokens
from graphloom.llm.queries import ORACLE_SQL, QUERIES

ITEM = " ".join(f"benchword{i}" for i in range(14))
SECRET = "token = \"" + "0123456789abcdef" * 3 + "\""
GOOD = range(60)


def texts():
    """Good prose (0-59, of which 7 has a secret), exact copies of 3, a near copy, a benchmark passage, junk, and odd rows."""
    good = {i: " ".join(unlike(1, 1000 * i + k) for k in range(80 + i)) for i in GOOD}
    good[7] += " " + SECRET + " the end of this text"
    good[8] += " mail me at a.b@c.example.org or +1 (555) 123-4567, from 10.1.2.3, card 4111 1111 1111 1111"
    rows = dict(good)
    rows |= {100 + i: good[3] for i in range(5)} | {110: good[30] + " more"}
    rows |= {200: f"{good[20][::-1]} {ITEM} {prose(40, 5)}", 201: f"{unlike(90, 77)} {' '.join(ITEM.split()[2:11])}"}
    rows |= {300: "word " * 50, 301: "too short", 302: None, 303: "", 304: " ".join(w + "###" for w in unlike(90, 9).split())}
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en" if i % 7 else None, "src", len(t or "")) for i, t in sorted(texts().items())]
    article = "<article><h1>Head {i}</h1><p>One  two &amp; {i}<br>three</p><section class=comments>first!</section></article>"
    big = SHELL.format(body="<article><p>" + "same " * 300 + "</p></article>")
    pages = [(i, f"http://a.example/{i}", SHELL.format(body=article.replace("{i}", str(i)))) for i in range(6)] + [(10, "http://b.example", big), (12, "http://b.example/2", big), (13, None, None)]
    turns = [(1, 0, "user", "hi </s>[INST]"), (1, 1, "assistant", "ünï 💡 \\ [/INST]"), (2, 0, "assistant", None), (2, 1, "assistant", "x y")]
    items = [(1, ITEM), (2, "unheard of words in this item only"), (3, " ".join(ITEM.split()[:9])), (4, None)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("pages", pages, "page_id long, url string, html string"),
        ("conversations", turns, "conv_id long, turn long, role string, text string"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{at}/{name}.parquet")
    return f"file://{at}"


def by_id(spark, folder, name, key="doc_id"):
    got = QUERIES[name](spark, folder).collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op1(spark, folder):
    got = by_id(spark, folder, "op1_chat_formatting", "conv_id")
    probe = "</s>[INST] ok [/INST]"
    want = {1: [("user", "hi </s>[INST]"), ("assistant", "ünï 💡 \\ [/INST]")], 2: [("assistant", ""), ("assistant", "x y")], -7: [("user", probe), ("assistant", probe)]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert got[c].formatted_chars > sum(len(r) + len(t) for r, t in turns)


def places(rows, end, size):
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in rows.items()}, size


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, folder):
    ids, size = places(texts(), 0, 2048)
    got = QUERIES["op2_best_fit_packing"](spark, folder).collect()
    want = sorted((i, k, k * size, len(x[k * size : k * size + size]), crc(x[k * size : k * size + size])) for i, x in ids.items() for k in range(math.ceil(len(x) / size)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b[:k]) == at for b in map(sorted, bins.values()) for k, (at, _) in enumerate(b)) and len(bins) <= packing.lower_bound(w[3] for w in want) + 1


def test_op4(spark, folder):
    got = by_id(spark, folder, "op4_simhash_near_dedup")

    class Row:
        def __init__(self, i, fp):
            self.doc_id, self.fp = i, fp

    rows = [Row(i, reference_fingerprint(t)) for i, t in texts().items()]
    classes = {i: c for (i, _), c in brute_classes(rows, 3).items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {r.doc_id: (f"{r.fp:016x}", classes[r.doc_id]) for r in rows}
    assert classes[104] == 3


def test_op5_and_op7(spark, folder):
    for name, kinds, columns, rules in (
        ("op5_personal_data", ["email", "ip", "card", "phone"], ["n_email", "n_ip", "n_card", "n_phone"], [(p, lambda m, ok=ok: ok(m[0])) for p, ok in PII_BASE]),
        ("op7_secret_scans", ["assign", "access", "hex"], ["n_assign", "n_access", "n_hex"], [SECRET_BASE[k] for k in range(3)]),
    ):
        got = by_id(spark, folder, name)
        for i, t in texts().items():
            found = [(k, a, b) for k, (p, ok) in enumerate(rules) for a, b in finditer(p, t or "", ok)]
            if name.startswith("op7"):
                found.sort(key=lambda x: (x[1], x[0]))
            base = ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in found)
            assert [got[i][c] for c in columns] == [sum(x[0] == k for x in found) for k in range(len(kinds))]
            assert got[i].base_sha256 == sha(base) and set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert re.search(r"random:\d+:\d+", got[7].spans)


def test_op6(spark, folder):
    got = by_id(spark, folder, "op6_quality_rules")
    assert all(got[i].base_failed and not got[i].kept for i in (300, 301, 302, 303))
    assert all(got[i].kept and not got[i].base_failed for i in GOOD) and not got[304].kept and not got[304].base_failed


def test_op8(spark, folder):
    ids, _ = places(texts(), 2, 0)
    start, got = 0, by_id(spark, folder, "op8_orc_token_ids")
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids[i]), crc(ids[i]))
        start += len(ids[i])


def test_op9(spark, folder):
    got = by_id(spark, folder, "op9_html_extraction", "page_id")
    assert {i: (r.text, r.n_chars) for i, r in got.items() if i < 6} == {i: (t, len(t)) for i in range(6) for t in [f"Head {i}\nOne two & {i} three"]}
    assert got[10].text == got[12].text == ("same " * 300).strip() and (got[13].text, got[13].n_chars, got[13].url) == ("", 0, None)


def test_op10(spark, folder):
    items = [(1, ITEM), (2, "unheard of words in this item only"), (3, " ".join(ITEM.split()[:9])), (4, None)]
    got = by_id(spark, folder, "op10_decontamination")
    for i, t in texts().items():
        n, hit, found = brute_hits(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(found), sha(",".join(sorted(found))), len(found) >= 2)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{folder[7:]}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    plain = lambda r: tuple(str(float(x)) if isinstance(x, float) or c == "refers_to" and x is not None else str(x) for c, x in zip(columns, r, strict=True))
    got = QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(plain, got)) == sorted(map(plain, want.select(", ".join(columns)).fetchall()))


def test_pipeline(spark, folder):
    """Planted junk, copies, passages and secrets go; clean documents stay, and the packed ids are those of the redacted texts."""
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in rows}
    near = {110, 30} if brute_classes([type("R", (), {"doc_id": i, "fp": reference_fingerprint(texts()[i])}) for i in (30, 110)], 3)[(110, reference_fingerprint(texts()[110]))] != 30 else {30}
    assert kept == set(GOOD) | near
    clean = {i: t for i, t in texts().items() if i in kept}
    clean[7] = re.sub(r"token = \"[0-9a-f]+", "[ASSIGN]", clean[7])
    ids, _ = places(clean, 0, 2048)
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: crc(x) for i, x in ids.items()}
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "secret scans", "best-fit packing"]
