"""Names, personal data, subjects and scanned pages on small fixtures."""

from docketeer.llm import boosting, name_links, personal_data, scan_repair, subjects

GIVEN = ["Margaret", "Theodore", "William", "Anthony"]
SURNAMES = ["Halloway", "Brinkmann", "Castellan", "Drummond", "Ellsworth", "Fairbanks"]


def registry(spark):
    people = [(f"ent-{g[0]}{s[0]}", "Person", f"{g} {s}") for g in GIVEN for s in SURNAMES]
    orgs = [(f"ent-o{i}", "Organization", f"{n} {a} {b} Ltd") for i, n in enumerate(["Quorvex", "Zanthor", "Meldrake", "Pondrick"]) for a, b in [(["Marine", "Summit"][i % 2], ["Media", "Freight"][i // 2])]]
    orgs += [(f"ent-p{i}", "Organization", f"{n} {a} {b} Inc") for i, n in enumerate(["Abelard", "Bosworth", "Corvina", "Dunmore"]) for a, b in [(["Marine", "Summit"][i % 2], ["Media", "Freight"][i // 2])]]
    places = [(f"ent-l{i}", "Location", f"{n} Harbor") for i, n in enumerate(["Alder", "Birch", "Cedar", "Dover"])]
    return spark.createDataFrame(people + orgs + places + [("ent-null", "Person", None)], "id string, entity_type string, canonical_name string")


def test_name_variants(spark):
    variants = {
        "x1": ("Person", "HALLOWAY, Margaret J", "ent-MH"), "x2": ("Person", "Peggy Halloway", "ent-MH"), "x3": ("Person", "M. Halloway", "ent-MH"), "x4": ("Person", "Hallowya Margaret", "ent-MH"), "x5": (None, "Dr Theodore Brinkman", "ent-TB"),
        "x6": ("Organization", "Quorvex Marine", "ent-o0"), "x7": ("Organization", "the Zanthor Summ Media", "ent-o1"), "x8": ("Organization", "Marine Freight Meldrake", "ent-o2"), "x9": (None, "Pondrick Summit Frieght Limited", "ent-o3"), "x10": ("Person", "Exhibit A", None), "x11": ("Person", None, None), "x12": ("Person", "", None), "x13": ("Location", "Margaret Hallowey", None),
    }
    xtr = spark.createDataFrame([(f"xtr-{k}", t, n, "d") for k, (t, n, _) in variants.items()], "id string, entity_type string, raw_name string, document_id string")
    for common in (name_links.COMMON, 2, 0):
        # refining common keys changes no pair
        got = {(r.id_a, r.id_b) for r in name_links.link_names(registry(spark), xtr, nicknames={"peggy": frozenset({"margaret"})}, common=common).collect()}
        assert got == {(e, f"xtr-{k}") for k, (_, _, e) in variants.items() if e}, common
    assert name_links.link_names(registry(spark).limit(0), xtr.limit(0)).count() == 0


def test_no_pair_within_the_slips_is_lost():
    import random

    rng = random.Random(3)
    p = name_links.Parser({"margaret"}, set())
    for _ in range(400):
        a = "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 13)))
        b = list(a)
        for _ in range(2 if len(a) > 10 else 1):
            i = rng.randrange(len(b))
            b[i : i + 1] = rng.choice([[], [rng.choice("klm")], [b[i], rng.choice("klm")]])
        b = "".join(b)
        if not name_links.near(a, b):
            continue
        assert name_links.pieces(a) & name_links.pieces(b), (a, b)
        x, y = (p.parse(f"{g} {s}", "Person") for g, s in (("Margaret", a), ("M.", b)))
        if name_links.same(p, x, y):
            key = next(k for k, _ in name_links.block_keys(p, x) if k in dict(name_links.block_keys(p, y)))
            # the two names meet from one side each
            for first, second in ((x, y), (y, x)):
                known = {k for k, side in name_links.refined_keys(p, first, key) if side != name_links.OTHER}
                assert known & {k for k, side in name_links.refined_keys(p, second, key) if side != name_links.KNOWN}


def test_short_forms_are_learned(spark):
    ents = spark.createDataFrame([(f"e{i}", "Person", f"Margaret {s}", [f"Peggy {s}"] if i < 2 else None) for i, s in enumerate(SURNAMES)] + [("e9", "Person", "Theodore Zabel", None), ("e10", "Person", "Anthony Zabel", [])], "id string, entity_type string, canonical_name string, aliases array<string>")
    xtr = spark.createDataFrame([("x1", "Person", "Ted Zabel", "d1"), ("x2", "Person", "Meg Drummond", "d2"), ("x3", "Person", "Ellsworth, Meg", "d3"), ("x4", None, None, None)], "id string, entity_type string, raw_name string, document_id string")
    men = spark.createDataFrame([("e9", "d1"), ("e9", None)], "entity_id string, document_id string")
    given = name_links.given_names(ents.select(ents.canonical_name.alias("name")))
    assert given == {"margaret": 6}
    assert name_links.short_forms(ents, xtr, men, given) == {"peggy": frozenset({"margaret"}), "meg": frozenset({"margaret"})}


def test_unrelated_names_change_no_word(spark):
    names = [f"{g} {s}" for g in GIVEN for s in SURNAMES]
    more = [f"Nobody{i} Unseen{i}" for i in range(40 * len(names))]
    few, many = ({k for k in name_links.given_names(spark.createDataFrame([(n,) for n in ns], "name string"))} for ns in (names, names + more))
    assert few == many == {g.lower() for g in GIVEN}


def test_lcs_against_dynamic_programming():
    import random

    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert name_links.lcs(a, b) == t[-1][-1]


def test_boosted_trees_learn_a_rule():
    rows = [(i % 7, i % 5, i % 3) for i in range(600)]
    labels = [int(r[0] > 3 and r[1] < 3) for r in rows]
    model = boosting.fit(rows, labels)
    assert all(model.accepts(r) == bool(y) for r, y in zip(rows, labels, strict=True))
    assert boosting.fit([], []).accepts((1, 2))


def test_personal_data(spark):
    lines = []
    for i, g in enumerate(GIVEN * 6):
        s = SURNAMES[i % 6]
        lines.append((f"p{i}", f"Contact: {g} {s}, phone (212) 555-01{i:02}. The passport {f'XK12345{i:02}' if i % 2 else f'912-34-56{i:02}'} belongs to {g[0]}. {s}. Reference 2610 2528 12{i:02} on page 4. Quorvex Marine Media Ltd met Judge {s} at Alder Harbor on 2020-01-{i % 28 + 1:02}. She lives at {i + 3} Elm Street, Dover 00{i:03}."))
    pages = spark.createDataFrame([*lines, ("q", None), ("r", "")], "id string, final_text string")
    none = spark.createDataFrame([], "id string, entity_type string, raw_name string, document_id string"), spark.createDataFrame([], "entity_id string, document_id string")
    r = personal_data.train(pages, registry(spark), *none)
    text = "Write to a.b@mail.example or a.b (at) mail (dot) example; Margaret J. Halloway, (212) 555-0199. ID XK9999999. Reference 2610 2528 1299. Judge Drummond of Alder Harbor knew Brinkmann, Theodore. Quorvex Marine Media Ltd."
    got = {(k, text[s:e]) for s, e, k in r.spans(text)}
    assert got == {("email", "a.b@mail.example"), ("email", "a.b (at) mail (dot) example"), ("person_name", "Margaret J. Halloway"), ("phone", "(212) 555-0199"), ("id_number", "XK9999999"), ("person_name", "Brinkmann, Theodore")}
    assert r.redact("Call (212) 555-0199 now") == "Call [PHONE] now" and r.redact(None) is None and r.redact("") == ""
    t = spark.createDataFrame([("t", "1", lines[0][1]), ("t", "1", lines[0][1]), ("t", "2", None)], "table_name string, record_id string, text string")
    assert {r_.value for r_ in personal_data.find_spans(t, r).where("kind = 'address'").collect()} == {"3 Elm Street, Dover 00000"}
    assert personal_data.redact_texts(t, r).count() == 3


def test_personal_data_counts_every_page(spark):
    # more pages than any sample took: five of them announce a number by a word of their own, and one of these came twice
    few = [(f"f{i}", f"Our hotline (212) 555-01{i:02} is open.") for i in range(personal_data.KNOWN_CUE)]
    pages = spark.createDataFrame([(f"p{i}", f"Nothing but line {i}.") for i in range(12_000)] + few + few[:1], "id string, final_text string")
    none = spark.createDataFrame([], "id string, entity_type string, raw_name string, document_id string"), spark.createDataFrame([], "entity_id string, document_id string")
    r = personal_data.train(pages, registry(spark), *none)
    assert {k: n for k, n in r.judges["phone"].cues.known.items() if k[0] < 3} == {(0, "hotline"): 5, (1, "our"): 5, (2, "is"): 5}
    assert "(3) 3-4" in r.lex.formats
    fewer = personal_data.train(pages.where("id <> 'f4'"), registry(spark), *none)
    assert (0, "hotline") not in fewer.judges["phone"].cues.known


def test_equal_rows_are_counted():
    rows = [(i % 7, i % 5, i % 3) for i in range(600)]
    parts = ({}, {})
    for i, r in enumerate(rows):
        parts[i % 3 == 2].setdefault(r, [0, 0])[r[0] > 3] += 1
    one, other = boosting.fit(rows, [int(r[0] > 3) for r in rows]), boosting.fit_counts(*parts)
    assert one.threshold == other.threshold and all(one.score(r) == other.score(r) for r in rows)
    # heavy rows of one label don't throw the others off
    heavy = {(0,): [10_000_000, 1], (1,): [1, 10_000_000], (2,): [5_000_000, 3]}
    model = boosting.fit_counts(heavy, heavy)
    assert [model.accepts(r) for r in heavy] == [False, True, False]


def test_subjects_flow_to_unlabelled_documents(spark):
    law, sea = ["the merger review", "the cartel ledger", "entry barriers"], ["the river sediment", "the landfill liner", "solvent drums"]

    def doc(topics, n):
        return " ".join(f"They spoke about {topics[i % 3]} again." for i in range(n)) + " Nothing else was said by anyone there."

    docs = [(i, doc(law, 4)) for i in range(8)] + [(i, doc(sea, 4)) for i in range(8, 16)] + [(20, doc(law, 3)), (21, doc(sea, 1)), (22, doc(law, 3) + " " + doc(sea, 3)), (23, None), (24, ""), (25, "Nothing else was said.")]
    labels = [(i, "law") for i in range(6)] + [(i, "sea") for i in range(8, 14)] + [(7, None), (999, "law"), (0, "sea")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects(d, lab, least_z=2.0).collect()}
    assert got == {(i, "law") for i in range(8)} | {(i, "sea") for i in range(8, 16)} | {(20, "law"), (22, "law"), (22, "sea")}
    assert subjects.subjects(d, lab.limit(0)).count() == 0


def test_few_labels_reach_all_similar_documents(spark):
    law, sea = ["the merger review", "the cartel ledger", "entry barriers"], ["the river sediment", "the landfill liner", "solvent drums"]
    docs = [(2 * i + s, " ".join(f"They spoke about {p} again." for p in topics) + " Nothing else was said by anyone there.") for i in range(80) for s, topics in enumerate((law, sea))]
    labels = [(2 * i + s, name) for i in range(5) for s, name in enumerate(("law", "sea"))]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    assert {(r.doc_id, r.subject) for r in subjects.subjects(d, lab, least_z=2.0).collect()} == {(2 * i + s, name) for i in range(80) for s, name in enumerate(("law", "sea"))}


def test_labels_over_all_ties_against_every_pair(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    places = {(x, i, rng.choice([1, 1, 1, 2, 3, 4, 5, 6])) for x in range(30) for i in range(rng.randrange(1, 6))} | {(99, 0, 1)}
    label = {(x, rng.choice("ab")): rng.choice([0.5, 1.0]) for x in range(0, 30, 2)}
    having = subjects.shared_phrases(spark.createDataFrame(sorted(places), "doc_id long, sentence int, phrase long"))
    own = having.groupBy("doc_id").agg(F.sum(F.col("k") * F.col("walk")).alias("own"))
    got = {(r.doc_id, r.subject): r.m for r in subjects.over_ties(having, own, spark.createDataFrame([(x, s, y) for (x, s), y in label.items()], "doc_id long, subject string, y double")).collect()}
    k = {x: {p: sum(q == p for z, _, q in places if z == x) for p in {q for z, _, q in places if z == x}} for x in {z for z, _, _ in places}}
    k = {x: ps for x, ps in k.items() if sum(ps.values()) > 1}
    of = {p: sum(ps.get(p, 0) for ps in k.values()) for p in range(1, 7)}
    want: dict = {}
    for x in k:
        for (y, s), v in label.items():
            tie = sum(n * k[y].get(p, 0) / of[p] for p, n in k[x].items()) if y in k and y != x else 0
            if tie:
                want[x, s] = want.get((x, s), 0) + tie * v
    assert 99 not in k and got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_sentence_ends():
    assert len(subjects.sentences("As told by J. Smith v. Jones, no. 4. Then it\nended! “Really?” yes")) == 4


def test_within_one_against_brute_force():
    words = ["arm", "barn", "burn", "bum", "turn", "tum", "modern", "modem", "could", "cold"]
    trie = scan_repair.build_trie(words)

    def reach(w):
        out = set()
        for v in words:
            for i in range(len(v) + 1):
                for a in (0, 1, 2):
                    for b in (0, 1, 2):
                        if a + b and not (a == b == 2) and v[i + a :] == w[i + b :] and v[:i] == w[:i] and i + a <= len(v) and i + b <= len(w) and (a, b) != (0, 2) and (a, b) != (2, 0):
                            out.add(v)
        return out - {w}

    for w in ("bam", "bum", "tum", "modem", "cou1d", "colcl", "buum", "tvm"):
        assert {v for v, *_ in scan_repair.within_one(trie, w)} - {w} == reach(w), w


def test_no_tail_is_followed_in_vain_from_its_start(monkeypatch):
    trie, follow, wasted = scan_repair.build_trie(["arm", "barn", "burn", "bum", "turn", "tum", "modern", "modem", "could", "cold"]), scan_repair._follow, []
    monkeypatch.setattr(scan_repair, "_follow", lambda node, rest: (wasted.append(rest) if rest[:1] not in node else None) or follow(node, rest))
    assert {v for v, *_ in scan_repair.within_one(trie, "colcl")} == {"cold"} and not wasted


def test_digits_and_first_letters_of_lines():
    for line in ("", "Filed 04/24/14", "Ärzte ² gegen ٣ – 4", "1:13-cv-02912 - 2013 - 2014 - 04/24/14 - 05/25/15 of the Records", "12 · 13"):
        assert scan_repair._digits(line) == sum(c.isdigit() for c in line) and scan_repair._begins(line) == scan_repair._bare(line)[:9]


def test_scanned_page(spark):
    clean = "The quarterly ledger mentions the committee and the witness. " * 300
    scan = "Case 1:13-cv-02912   Document 161   Filed 04/24/14\nThe quartcrly ledger mentions the commit-\n- 2 -\ntee and the witness.\n\nThe ledger · mentions the w1tness of 2O14 --\nand the committee."
    # pages of one document share their header and nothing else
    other = ["Case 1:13-cv-02912   Document 161   Filed 04/24/14\nThe quarterly ledger mentions the committee " + c * 3 + ".\n\nNo witness of " + c * 4 + " · mentions the ledger" for c in "abcdefghijkl"]
    scans = [(f"s{i}", f"d{i // 3}", 2, True, scan if i % 3 == 0 else other[i], None) for i in range(12)]
    # the scanner's habits must be seen in three words or more to be learned, and its marks be rare on clean pages
    habits = "\n".join(["The lcdger mcntions thc committcc and thc witncss.", "The quarterly ledgcr and the wítness ment1on the comm1ttee, which comm1ttees ment1ons."] * 2)
    scans += [(f"h{i}", None, 1, True, habits, habits) for i in range(3)]
    rows = [("c", "x", 1, False, None, clean), *scans, ("n", "y", 1, True, None, None), ("e", "z", 1, True, "", None), ("o", "one", 2, True, scan, None), scans[0]]
    pages = spark.createDataFrame(rows, "id string, document_id string, page_number int, ocr_used boolean, ocr_text string, final_text string")
    noise = scan_repair.find_noise(pages).collect()
    # a header that returns in other documents is known in one of a single page
    assert (0, "header") in {(r.line_no, r.kind) for r in noise if r.page_id == "o"}
    found = {(r.line_no, r.kind) for r in noise if r.page_id == "s0"}
    assert found == {(0, "header"), (1, "misread"), (1, "hyphen"), (2, "page_number"), (5, "misread")}
    text = {r.page_id: r.text for r in scan_repair.repair(pages).collect()}
    assert text["s0"] == "The quarterly ledger mentions the committee and the witness.\n\nThe ledger mentions the witness of 2014 -- and the committee." and text["n"] is None and text["e"] == ""
    assert scan_repair.find_noise(pages.limit(0)).count() == 0


def test_page_numbers_and_headers():
    assert [scan_repair.page_number_of(x) for x in ("- 3 -", "[4]", "Page 2 of 9", "Pagc 2", "iv", "p. l", "$ 116", "2013.", "Exhibit 3")] == [3, 4, 2, 2, 4, 1, None, None, None]
    assert scan_repair.line_kinds(["- 1 -", "", "Some text"], 1) == ["page_number", "blank", "text"]
