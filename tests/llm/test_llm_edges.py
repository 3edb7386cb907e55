"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from docquarry.llm import attribution, brown, components, contamination, editprint, licenses, lines, packing, quality, simhash, substrings
from docquarry.llm.packing import Plan

LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
SHARED = " ".join(f"shared{i}" for i in range(40))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta\nA line of text here\nx"),
    (2, None), (3, ""), (4, "   \n\t "), (None, SHARED), (None, None), (5, SHARED + " tail five"), (6, "head six " + SHARED),
    (7, LONG), (8, "a line of text here  \nother"), (8, "a line of text here  \nother"), (9, "ünïcödé " * 30 + "\U0001F600"), (10, "a line of TEXT here"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    """The same rows with columns named like those the operators make."""
    names = "n_lines, keep, tag, drops, bucket, u, v, part, length, score, label, x, train, fingerprint, size, hash, component_id, n_words, w".split(", ")
    return spark.createDataFrame([(*r, *[7] * len(names)) for r in ROWS], SCHEMA + "".join(f", {n} int" for n in names))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, SHARED), (1, SHARED), (2, None), (3, ""), (4, "tail five"), (5, "never seen words stand in this item"), (None, SHARED)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (3, 0, 0), (4, 0, 0), (2, 0, 0), (8, None, 0), (None, 1, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "brown": lambda d, i, l: brown.score_texts(d, core=64, classes=4),
    "packing": lambda d, i, l: packing.pack(d, with_ids=True),
    "substrings": lambda d, i, l: substrings.without_repeated_runs(d),
    "contamination": lambda d, i, l: contamination.contained_items(d, i),
    "licenses": lambda d, i, l: licenses.scan(d),
    "lines": lambda d, i, l: lines.without_repeated_lines(d).select("doc_id", "text", "n_lines", "n_dropped", "keep"),
    "quality": lambda d, i, l: quality.quality_scores(d, l),
    "editprint": lambda d, i, l: editprint.edited_fingerprints(d),
    "attribution": lambda d, i, l: attribution.token_counts(d),
    "simhash": lambda d, i, l: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_columns_change_nothing(odd, clashing, items, labels, name):
    def seen(docs):
        return sorted(map(repr, (r.asDict() for r in OPERATORS[name](docs, items, labels).drop("sequence_id", "offset").collect())))

    assert seen(odd) == seen(clashing)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(empty, items, labels, name):
    assert OPERATORS[name](empty, items, labels).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("contamination", "packing", "attribution")])
def test_every_row_has_its_result(odd, items, labels, name):
    found = OPERATORS[name](odd, items, labels).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted((r[0] for r in ROWS), key=repr)


def test_lines(odd):
    found = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in OPERATORS["lines"](odd, None, None).collect()}
    assert found[(8, "other")] == (2, 1) and found[(10, "")] == (1, 1)
    assert found[(1, ROWS[0][1])] == (3, 0) and found[(2, "")] == (1, 0) and found[(None, SHARED)] == (1, 0)


def test_lines_of_one_document_are_kept_and_short_keys_too(spark):
    docs = spark.createDataFrame([(1, "same line twice\nsame line twice\nshort"), (2, "x\nSAME LINE TWICE \nshort\nsame line twice"), (3, "nine char\nééééééééé")] + [(4, "nine char\nééééééééé")], SCHEMA)
    found = {r.doc_id: r.text for r in lines.without_repeated_lines(docs).collect()}
    assert found == {1: "same line twice\nsame line twice\nshort", 2: "x\nshort", 3: "nine char\nééééééééé", 4: "nine char\nééééééééé"}


def test_substrings(odd):
    found = {(r.doc_id, r.text): (r.n_words, r.n_removed) for r in OPERATORS["substrings"](odd, None, None).collect()}
    assert found[(5, SHARED + " tail five")] == (42, 0)
    assert found[(6, "head six")] == (42, 40)
    assert found[(None, SHARED)] == (40, 0) and found[(2, "")] == (0, 0)


@pytest.mark.parametrize("length", [1, 4, 9, 13, 50])
def test_substrings_of_any_length(spark, length):
    import random

    source = random.Random(length)
    texts = []
    for i in range(60):
        words = [f"w{source.randrange(400)}" for _ in range(source.randrange(0, 160))]
        if texts and source.random() < 0.6:
            other = source.choice(texts).split()
            at = source.randrange(len(other) + 1)
            words[len(words) // 2 : len(words) // 2] = other[at : at + source.randrange(1, 90)]
        texts.append(" ".join(words))
    windows = {}
    for i, text in enumerate(texts):
        words = text.split()
        for k in range(len(words) - length + 1):
            windows.setdefault(tuple(words[k : k + length]), i)
    wanted = {}
    for i, text in enumerate(texts):
        words = text.split()
        gone = set()
        for k in range(len(words) - length + 1):
            if windows[tuple(words[k : k + length])] < i:
                gone.update(range(k, k + length))
        wanted[i] = " ".join(w for k, w in enumerate(words) if k not in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert {r.doc_id: r.text for r in substrings.without_repeated_runs(docs, length).collect()} == wanted


def test_contamination(odd, items):
    found = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in contamination.contained_items(odd, items).collect()}
    assert found == {(5, 1): (36, 36), (6, 1): (36, 36), (5, 4): (1, 1)}
    kept = contamination.without_contaminated(odd, items)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in ROWS if r[0] not in (5, 6)), key=repr)


def test_partly_contained_items(spark):
    words = [f"b{i}" for i in range(54)]  # 50 shingles, of which 40 must stand in the document
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"start {'filler ' * 500}" + ", ".join(words[:k]).upper()) for k in (42, 43, 44, 45, 54)], SCHEMA)
    found = {r.doc_id: r.n_found for r in contamination.contained_items(docs, items).collect()}
    assert found == {44: 40, 45: 41, 54: 50}


def test_simhash_groups(spark):
    docs = spark.createDataFrame(ROWS + [(70, LONG), (71, LONG + " more")], SCHEMA)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert found[70].component_id == found[71].component_id == 7
    assert found[2].fingerprint == found[3].fingerprint == found[4].fingerprint == 0 and found[3].component_id <= 2


@pytest.mark.parametrize("distance", [1, 3, 4, 6])
def test_links_are_complete(spark, distance):
    import random

    source = random.Random(distance)
    values = {0, -1, 2**63 - 1, -(2**63)}
    for _ in range(60):
        value = source.getrandbits(64)
        for _ in range(source.randrange(1, 5)):
            for bit in source.sample(range(64), source.randrange(0, distance + 3)):
                value ^= 1 << bit
            values.add(value - (1 << 64) if value >> 63 else value)
    wanted = {(u, v) for u in values for v in values if u < v and ((u ^ v) & (2**64 - 1)).bit_count() <= distance}
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    assert {(r.u, r.v) for r in simhash.links(prints, distance).collect()} == wanted


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(3, 3), (5, 4), (4, 5), (7, None), (9, 8), (8, 200), (200, 130)]
    found = {r.u: r.v for r in components.components(spark.createDataFrame(chain, "u long, v long").repartition(7)).collect()}
    assert found == {**{i: 8 for i in [9, 200, *range(100, 161)]}, 5: 4}


def test_plan_packs_all_pieces():
    import random

    for capacity in (1, 7, 30, 1024):
        for seed in range(20):
            source = random.Random(seed)
            counts = {}
            for _ in range(source.randrange(200)):
                size = source.randint(1, source.choice([capacity, max(1, capacity // 3)]))
                counts[size] = counts.get(size, 0) + 1
            plan, packed = Plan(dict(counts), capacity), {}
            for pattern, n in plan.patterns:
                assert sum(pattern) <= capacity and n > 0 and sum(3 * s > capacity for s in pattern) <= 2
                for size in pattern:
                    packed[size] = packed.get(size, 0) + n
            assert packed == counts
            assert plan.sequences <= max(1.25 * -(-sum(s * n for s, n in counts.items()) // capacity) + 1, sum(n for s, n in counts.items() if 2 * s > capacity))


def test_license_template_with_an_inserted_word(spark):
    text = "intro words here. Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files. end"
    docs = spark.createDataFrame([(1, text), (2, "permission is hereby granted free of nothing"), (3, "Under The MIT License under the mit license")], SCHEMA)
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert found[1].labels == "mit" and found[1].n_base == 0 and 0.9 < found[1].score <= 1
    assert found[2].labels == "" and 0 < found[2].score < 0.8
    assert (found[3].n_base, found[3].first_word, found[3].last_word, found[3].base_labels) == (2, 0, 4, "mit")


def test_attribution_rules(spark):
    from pyspark.sql import functions as F

    sections = F.expr("array(named_struct('section', 'b', 'start', 8, 'end', 99), named_struct('section', 'a', 'start', 0, 'end', 8), null)")
    docs = spark.createDataFrame([(1, "Hello inventory"), (2, None)], SCHEMA)  # tokens: Hello, ' inventory'
    found = {rule: {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in attribution.token_counts(docs, sections, rule).collect()} for rule in attribution.RULES}
    assert {k: v for k, v in found["start"].items() if k[0] == 1} == {(1, "a"): (2, 1), (1, "b"): (0, 0)}
    for rule in ("end", "most"):
        assert {k: v for k, v in found[rule].items() if k[0] == 1} == {(1, "a"): (1, 0), (1, "b"): (1, 1)}
    assert found["start"][(2, "a")] == (0, 0)


def test_edit_search_finds_an_edited_copy(spark):
    base = " ".join(f"term{i * 7919 % 1000}" for i in range(600))
    docs = spark.createDataFrame([(1, base), (2, base.replace("term500", "term5000")), (3, " ".join(f"other{i}" for i in range(600)))], SCHEMA)
    prints = {r.doc_id: r.fingerprint for r in editprint.fingerprints(docs).collect()}
    found = {r.fingerprint: r.likeness for r in editprint.edit_search(docs, docs.filter("doc_id = 1")).collect()}
    assert found[prints[1]] == 1 and found[prints[2]] >= 0.8 and prints[3] not in found


def test_similar_groups_find_what_brute_force_finds(spark):
    import random

    source = random.Random(3)
    texts = []
    for i in range(120):
        words = [f"t{source.randrange(3000)}" for _ in range(source.randrange(60, 300))]
        if texts and i % 2:
            words = source.choice(texts).split()
            for _ in range(source.randrange(0, 7)):
                words[source.randrange(len(words))] = f"n{source.randrange(9999)}"
        texts.append(" ".join(words))
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    pairs = [(a, b) for a in range(120) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (500, None), (501, "")], SCHEMA)
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.98 * len(pairs) and len(pairs) > 20
    assert found[501] == 500 and None not in found
    for i, own in found.items():
        if own != i and i < 120:
            assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(120) if j != i and found[j] == own) >= 0.6
    kept = simhash.first_of_group(docs)
    assert kept.filter("doc_id IS NULL").count() == 1 and kept.count() == len(set(found.values())) + 1


def grouped_as_brute_force(spark, texts):
    """Pairs of 0.8 or more by brute force, and how many of them ``similar_groups`` puts together."""
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    return pairs, sum(found[a] == found[b] for a, b in pairs)


def test_similar_groups_find_added_cut_and_changed_copies(spark):
    import random

    source = random.Random(5)
    texts = []
    for i in range(60):
        words = [f"t{source.randrange(4000)}" for _ in range(source.randrange(100, 600))]
        part = int(len(words) * source.uniform(0.12, 0.19))
        changed = list(words)
        for at in source.sample(range(len(words)), len(words) // 60):
            changed[at] = f"n{at}"
        texts += [" ".join(x) for x in (words, words + [f"a{i}x{k}" for k in range(part)], words[:-part], words[part:], changed)]
    pairs, together = grouped_as_brute_force(spark, texts)
    assert len(pairs) > 240 and together == len(pairs)


def test_similar_groups_of_one_vocabulary(spark):
    """Texts of the same distinct words in other orders: nothing but their shingles tells them apart."""
    import random

    source = random.Random(6)
    vocabulary = [f"column{i}" for i in range(200)]
    texts = []
    for _ in range(20):
        words = source.sample(vocabulary, 200)
        texts += [" ".join(words), " ".join(words + words[:20]), " ".join(words[:150] + words[160:] + words[150:160])]
    pairs, together = grouped_as_brute_force(spark, texts)
    assert len(pairs) >= 40 and together == len(pairs)


@pytest.mark.parametrize("shift, least", [(1, 0.9), (10, 0.75), (50, 0.4)])
def test_walks_come_back_into_step(shift, least):
    """Characters put in or taken out at the front leave most of a long text alike."""
    import random

    source = random.Random(shift)
    found = []
    for _ in range(20):
        text = "".join(source.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20_000))
        front = "".join(source.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(shift))
        prints, _ = editprint.fingerprint_texts([text, front + text, text[shift:]], [None] * 3)
        found += [editprint.compare(prints, 0, prints, 1), editprint.compare(prints, 0, prints, 2)]
    print(sum(found) / len(found))
    assert sum(found) / len(found) >= least


def test_edit_search_finds_what_brute_force_finds(spark):
    """Recall for the documents divisible by 50, with copies on both sides of a power of two characters."""
    import random

    source = random.Random(9)
    texts = []
    for i in range(400):
        if i % 50 == 0:
            base = "".join(source.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range([40, 130, 500, 1030, 2040, 2060, 4090, 9000][i // 50]))
        text = list(base)
        for _ in range(i % 50 * len(base) // 2000):
            text[source.randrange(len(text))] = source.choice("0123456789")
        if i % 3 == 1:
            text += source.choices("XYZ", k=1 + len(base) // 20)
        if i % 3 == 2:
            del text[len(base) - len(base) // 16 :]
        texts.append("".join(text))
    prints, _ = editprint.fingerprint_texts(texts, [None] * len(texts))
    wanted = {(prints.text(i), prints.text(j)) for i in range(0, 400, 50) for j in range(400) if editprint.compare(prints, i, prints, j) >= 0.8}
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = {(r.query, r.fingerprint) for r in editprint.edit_search(docs, docs.filter("doc_id % 50 = 0")).collect()}
    print("recall", len(found & wanted) / len(wanted), len(wanted))
    assert len(wanted) > 80 and found <= wanted and len(found & wanted) >= 0.9 * len(wanted)
    assert any(len(a) != len(b) for a, b in found)


def test_no_text_with_a_similar_one_is_ruled_out(spark):
    """Pairs of sizes around the bound where counting changes, each within 0.8, among texts of their own."""
    import random

    from docquarry.llm.simhash import _PIECE, _parts_of

    draw, rows = random.Random(8), []
    for i in range(160):
        size = draw.choice([1, 3, 7, 30, 120, 150, 160, 185, 191, 192, 200, 235, 240, 245, 600])
        words = [f"w{i}x{j}" for j in range(size)]
        other = words[: max(1, int(size * draw.uniform(0.83, 1)))] if i % 2 else words + [f"v{i}x{j}" for j in range(int(size * draw.uniform(0, 0.2)))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    alone = [(1000 + i, " ".join(f"a{i}x{j}" for j in range(draw.choice([5, 40, 170, 300, 900])))) for i in range(200)]
    docs = spark.createDataFrame(rows + alone, SCHEMA).repartition(6)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows}
    similar = {i for k in range(160) for i in (2 * k, 2 * k + 1) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    assert len(similar) > 150
    parts = docs.mapInArrow(_parts_of(5, 5, simhash.SHORT), _PIECE).cache()
    left = {r.text_key for r in simhash.possible(parts).collect()}
    key_of = {i: k for r in parts.select("doc_ids", "keys").collect() for i, k in zip(r.doc_ids, r.keys)}
    assert {i for i in similar if key_of[i] not in left} == set()
    assert sum(key_of[i] in left for i, _ in alone) <= 20  # texts of their own are mostly ruled out
