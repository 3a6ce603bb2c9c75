"""Each stage of the pipeline, and all of them together, against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest import DOCS, prose
from test_brute_force import _components, kneser_ney

from tarn.llm import toxicity

BAD = ["scumbag", "worthless", "idiotic"]


@pytest.fixture(scope="module")
def corpus():
    """(rows of documents, labels): toxic texts, copies, near copies, sources of unlike sizes, and texts without words."""
    r, rows, labels = random.Random(11), [], []
    for i in range(240):
        text = prose(i % 200, 12 + i % 90).split()
        bad = i % 8 == 3
        for _ in range(3 if bad else 0):
            text.insert(r.randrange(len(text)), r.choice(BAD))
        rows.append((i, " ".join(text), "en", r.choice(["a"] * 6 + ["b", "c", None]), len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(400 + i, rows[i][1] + " and one more", "en", "a", 0) for i in range(60, 90, 3)]
    rows += [(500 + i, rows[i][1], "de", "a", 0) for i in range(0, 60, 2)]
    rows += [(600, "", "en", "b", 0), (601, None, "en", "b", 0), (602, " \n", "en", None, 3)]
    return rows, labels


def plain_toxic(rows, labels):
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    toxic = {i: t for i, _, t in labels}
    seen = [Counter(), Counter()]
    for i, text, *_ in rows:
        if i in toxic and fold(i) in (0, 1):
            seen[toxic[i]].update((text or "").lower().encode().split())
    ratio, cache = kneser_ney(*seen), {}

    def features(text):
        values = [cache.setdefault(w, None) if cache.get(w) is not None else cache.__setitem__(w, ratio(w)) or cache[w] for w in (text or "").lower().encode().split()]
        if not values:
            return 0.0, 0.0, 0.0
        k = min(toxicity.WINDOW, len(values))
        once = [cache[w] for w in set(text.lower().encode().split())]
        excess = sum(max(v - toxicity.CLEAR, 0) for v in once) / len(once) ** 0.5
        return max(sum(values[j : j + k]) for j in range(len(values) - k + 1)) / toxicity.WINDOW, sum(values) / len(values), excess

    curve = [(features(text), toxic[i]) for i, text, *_ in rows if i in toxic and fold(i) == 3]
    *weights, base = toxicity.fit_curve(np.array([x for x, _ in curve]), np.array([y for _, y in curve], float))
    kept = []
    for row in rows:
        if 1 / (1 + np.exp(-(np.dot(weights, features(row[1])) + base))) < 0.3:
            kept.append(row)
    return kept


def plain_copies(rows):
    last = {}
    for row in rows:
        key = row[1] or ""
        if key not in last or last[key][0] < row[0]:
            last[key] = row
    return list(last.values())


def plain_near_copies(rows):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = _components(links, sets)
    return [row for row in rows if root[row[0]] == row[0]]


def plain_mixture(rows):
    """Rows as often as they are taken: a sort by hash and running sums instead of histograms."""
    size = {row[0]: len((row[1] or "").split()) for row in rows}
    by = defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(order)}
    total = {s: sum(size[row[0]] for row in by[s]) for s in order}
    target, open_ = {}, list(order)
    left = float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        capped = [s for s in open_ if level * weight[s] > 3 * total[s]]
        for s in capped or open_:
            target[s] = 3.0 * total[s] if capped else level * weight[s]
        left -= sum(target[s] for s in capped)
        open_ = [s for s in open_ if s not in capped] if capped else []
    out = []
    for s in order:
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, upto = target[s] - whole * total[s], 0
        for row in sorted(by[s], key=lambda x: hashlib.md5(f"mix:{x[0]}".encode()).hexdigest()[:12]):
            n = size[row[0]]
            room = budget - upto
            upto += n
            more = upto <= budget or room >= 0 and n - room < room
            out += [row] * min(3, whole + more)
    return out


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_stages_equal_brute_force(spark, corpus, tmp_path):
    import corpus_pipeline

    rows, labels = corpus
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    plain = [lambda x: plain_toxic(x, labels), plain_copies, plain_near_copies, plain_mixture]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain, strict=False):
        want = brute(rows)
        assert 0 < len(want) and want != rows, name
        assert _rows(stage(spark, _docs(spark, rows), str(tmp_path))) == sorted(want, key=str), name
        rows = want

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts, by = {r[0]: r[1] or "" for r in rows}, defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        assert r.decodes and sp.decode(list(r.ids)) == texts[r.doc_id]
    times = Counter(r[0] for r in rows)
    assert set(by) == set(times)
    for i, rs in by.items():
        assert len(rs) == times[i] * (2 if texts[i] else 1) and len({tuple(r.ids) for r in rs}) == (2 if texts[i] else 1)
