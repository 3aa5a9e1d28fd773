import hashlib
import random
import re

import numpy as np
import pytest

from tablecare.llm import pii, tagger

from .helpers import EDGES, SMALL, documents


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_rules_match_plain_patterns():
    r = random.Random(4)
    for _ in range(4000):
        text = "".join(r.choice("ab.@-+ 0123456789012345()%é") for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain(text), text
    for long in ("a" * 200_000, "@" * 100_000, "1" * 200_000, "1." * 100_000 + "x", "+1" * 100_000):
        assert all(k != 2 or e - s < 40 for s, k, e in pii.base_spans(long))


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_gradients():
    r = np.random.default_rng(0)
    t = tagger.Tagger(9, pii._FORBIDDEN, embed=4, hidden=3)
    for k in t.p:
        t.p[k] = t.p[k].astype(np.float64)
    ids = r.integers(1, 100, (3, 7))
    ids[1, 5:] = 0
    tags = np.zeros((3, 7), int)
    tags[0, 2:4], tags[2, 1] = (1, 2), 5
    _, g = t.gradients(ids, tags)
    for name, at in (("out", (0, 3)), ("bias", (7,)), ("trans", (1, 2)), ("embed", (int(ids[0, 2]), 1)), ("cf", (1,)), ("xb", (3, 8))):
        old = t.p[name][at]
        t.p[name][at] = old + 1e-3
        up = t.gradients(ids, tags)[0]
        t.p[name][at] = old - 1e-3
        down = t.gradients(ids, tags)[0]
        t.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 0.01


def test_held_out_forms(model):
    held = pii.labelled_windows(["some words that stand around a thing and say nothing of it"], 600, seed=77)
    ids, tags = tagger.pad(held)
    got, _ = model.decode(ids)
    assert ((got == tags) | (ids == 0)).all(1).mean() > 0.9


def test_added_spans_are_reconciled(model):
    text = "Write to john.smith (at) example (dot) org or call (743) 555-3824. " + "x y z " * 30 + "Server 70[.]23[.]22[.]57 is down, a@b.com too"
    (base,), (more,) = pii.find_all([text], model)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in base] == [("email", "a@b.com")]
    assert ("email", "john.smith (at) example (dot) org") in [(pii.KINDS[k], text[s:e]) for s, k, e in more]
    assert ("ip", "70[.]23[.]22[.]57") in [(pii.KINDS[k], text[s:e]) for s, k, e in more]
    assert pii.find_all(["In 2024 we sold 1,234 units of v2.3 on 2024-05-06, hash 24be64439e3e49cf."], model)[1] == [[]]
    assert pii.reconcile([(0, 1, 5, 2.0), (3, 1, 8, 3.0), (6, 2, 9, 2.0)]) == [(0, 1, 5), (6, 2, 9)]


def test_rows_and_masks(spark, model, tmp_path):
    rows = [(20, "mail a.b@c.de, 4785380592391139 or +1 (743) 555-3824 at 10.0.0.1", "s"), (21, "4111 1111 1111 1111", "s"),
            (22, "w " * 30_000 + "a@b.com", "s")]
    docs = documents(spark, EDGES + rows, tmp_path)
    got = pii.personal_data(docs, model).toPandas()
    want = [plain(r["text"] or "") for r in docs.collect()]
    assert got["base_sha256"].tolist() == [hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest() for b in want]
    assert got[["n_email", "n_ip", "n_card", "n_phone"]].to_numpy().tolist() == [[sum(k == j for _, k, _ in b) for j in range(4)] for b in want]
    out = {r["doc_id"]: r["text"] for r in pii.masked(docs, model).collect()}
    assert out[21] == "[CARD]" and out[20].startswith("mail [EMAIL], ") and out[20].endswith("[PHONE] at [IP]") and out[1] is None
    assert pii.masked(docs, model).columns == docs.columns and pii.personal_data(docs.limit(0), model).count() == 0


def test_long_addresses_are_found_whole(model):
    forms = ["anna (at) host (dot) example (dot) com", "anna (at) physik (dot) example (dot) org", "anna.maria [at] mail [dot] physik [dot] example [dot] org",
             "wolfgang.amadeus.theophilus.mozart (at) host (dot) example (dot) com", "averyveryverylonglocalpartwithoutdots (at) example (dot) org"]
    for form in forms:
        for text in (form, form + " for more", "Write to " + form + " for more of the same", "words go on for quite a while until " + form + ". And then on and on they go"):
            base, (more,) = pii.find_all([text], model)
            assert base == [[]] and [(k, text[s:e]) for s, k, e in more] == [(0, form)], text


def test_windows_hold_long_forms_whole():
    for n in (1, 40, 400):
        form = "a" * n + " (at) host" + " (dot) example" * (n // 14) + " (dot) com"
        text = "word " * 50 + form + " word" * 50 + " (at) x (dot) org"
        s, e = text.index(form), text.index(form) + len(form)
        windows = pii.windows_of(text, [])
        assert len(form) > pii.WIDEST // 2 or any(a < s and e < b for a, b, _, _ in windows)
        assert all(c == (a > 0) and d == (b < len(text)) and b - a <= pii.WIDEST for a, b, c, d in windows)
    for long in ("(at) " * 20_000, "a" * 100_000 + "(at)" + "a." * 50_000, "(at) a (dot) " * 10_000, "1" * 100_000):
        assert sum(b - a for a, b, _, _ in pii.windows_of(long, [])) <= 3 * len(long) + pii.WIDEST
