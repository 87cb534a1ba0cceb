"""Registered queries that SQL can't express, whole, against plain Python over the same table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trustmill.llm import encoding, language, queries


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = encoding.Encoder(encoding.default_tokenizer()).tokenizer
    return {k: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for k, r in docs.items()}


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_token_table(spark, sf_dir, ids):
    want, start = [], 0
    for k in sorted(ids):
        own = [*ids[k], 2]
        want.append((k, start, len(own), crc(own)))
        start += len(own)
    assert sorted(map(tuple, queries.op8_token_table(spark, sf_dir).collect())) == want


def test_packing(spark, sf_dir, ids):
    rows = [r.asDict() for r in queries.op1_best_fit_packing(spark, sf_dir).collect()]
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert pieces.keys() == ids.keys()
    for k, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        whole, at = [*ids[k], 0], 0
        assert [r["piece"] for r in own] == list(range(len(own)))
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc(whole[at : at + r["length"]])
            at += r["length"]
        assert at == len(whole) and all(r["length"] == 2048 for r in own[1:]) and (len(own) == 1 or len(whole) > 2048)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(sequences) <= 1.02 * least + 1


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(re.sub("[^0-9]", "", x)) <= 15),
)
SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def test_personal_data(spark, sf_dir, docs):
    found = {r["doc_id"]: r for r in queries.op3_pii(spark, sf_dir).collect()}
    assert found.keys() == docs.keys()
    for k, r in docs.items():
        spans = [(name, m.start(), m.end()) for name, pattern, fits in PII for m in re.finditer(pattern, r["text"] or "") if fits(m[0])]
        base = [f"{name}:{a}:{b}" for name, a, b in spans]
        assert found[k]["base_sha256"] == sha(",".join(base))
        assert {name: found[k][f"n_{name}"] for name, *_ in PII} == {name: sum(s[0] == name for s in spans) for name, *_ in PII}
        assert set(base) <= set(found[k]["spans"].split(","))


def test_secrets(spark, sf_dir, docs):
    found = {r["doc_id"]: r for r in queries.op5_secrets(spark, sf_dir).collect()}
    assert found.keys() == docs.keys()
    for k, r in docs.items():
        spans = sorted((m.start(), i, m.end()) for i, (_, pattern, fits) in enumerate(SECRETS) for m in re.finditer(pattern, r["text"] or "", re.A) if fits(m))
        base = [f"{SECRETS[i][0]}:{a}:{b}" for a, i, b in spans]
        assert found[k]["base_sha256"] == sha(",".join(base))
        assert {name: found[k][f"n_{name}"] for name, *_ in SECRETS} == {name: sum(SECRETS[i][0] == name for _, i, _ in spans) for name, *_ in SECRETS}
        assert set(base) <= set(found[k]["spans"].split(","))


def test_language_scores(spark, sf_dir, docs):
    """Word-first backoff by plain dictionaries: shares of known words, else the mean of the longest known n-grams."""
    train = [r for k, r in docs.items() if zlib.crc32(str(k).encode()) % 5 and r["lang"] is not None]
    assert len(train) <= language.TRAIN_ROWS
    languages = sorted({r["lang"] for r in train})
    by_word, by_gram = {}, {}
    for r in train:
        for w in language.words(r["text"] or ""):
            by_word.setdefault(w, Counter())[r["lang"]] += 1
    for w, counts in by_word.items():
        for n in range(1, language.LONGEST_GRAM + 1):
            for g in language.grams(w, n):
                by_gram.setdefault(g, Counter()).update(counts)
    known = lambda table: {k: c for k, c in table.items() if sum(c.values()) >= language.MIN_COUNT}
    by_word, by_gram = known(by_word), known(by_gram)

    def logs(table, group):
        totals = {}
        for k, c in table.items():
            own = totals.setdefault(group(k), dict.fromkeys(languages, 0.0))
            for lang in languages:
                own[lang] += c[lang] + language.SMOOTHING
        return {k: [math.log((c[lang] + language.SMOOTHING) / totals[group(k)][lang]) for lang in languages] for k, c in table.items()}

    words, grams = logs(by_word, lambda k: 0), logs(by_gram, len)

    def of_word(w):
        if w in words:
            return words[w]
        for n in range(language.LONGEST_GRAM, 0, -1):
            rows = [grams[g] for g in language.grams(w, n) if g in grams]
            if rows:
                mean = [sum(x) / len(rows) for x in zip(*rows)]
                return [x - max(mean) for x in mean]
        return [0.0] * len(languages)

    found = {r["doc_id"]: r for r in queries.op4_language_id(spark, sf_dir).collect()}
    unseen = 0
    for k, r in docs.items():
        text = r["text"] or ""
        own = language.words(text) if any(c.isalpha() for c in text) else []
        if not own:
            assert (found[k]["lang_pred"], found[k]["score"]) == ("und", 0.0)
            continue
        unseen += sum(w not in words for w in own)
        total = [sum(x) for x in zip(*map(of_word, own))]
        best = max(range(len(languages)), key=lambda j: (total[j], -j))
        score = 1 / sum(math.exp(x - total[best]) for x in total)
        assert found[k]["score"] == pytest.approx(score, abs=2e-3)
        assert found[k]["lang_pred"] == languages[best] or score < 0.51
    assert unseen > 100
