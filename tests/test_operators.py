import itertools
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions import catalog as C
from dossier.operators import locate as L
from dossier.operators import matching as M
from dossier.operators import passages as P
from dossier.operators import profile as R
from dossier.operators import resampling as B
from dossier.operators import sections as X
from dossier.operators import scoring as S
from dossier.sources import answers, files, ledger, lookups, records, shared
from dossier.sources import paged as source
from dossier.streaming import ingest


def paged(spark, *pages):
    return spark.createDataFrame([("k", list(enumerate(pages, 1)))], f"key string, pages {L.PAGES}")


@pytest.mark.parametrize(
    "section,pages,start,end",
    [
        ("indications", ["1.1 INDICATIONS...........2", "INDICATIONS\nx"], 2, 2),
        ("indications", ["1.1 INDICATIONS 2 ", "INDICATIONS\nx"], 2, 2),
        ("adverse", ["ADVERSE REACTIONS....2\nDRUG INTERACTIONS...3", "ADVERSE REACTIONS\nx", "DRUG INTERACTIONS"], 2, 3),
        ("adverse", ["nothing"], 9, 14),
        ("interactions", ["DRUG\nINTER ACTIONS\nx 2", "y"], 2, 11),
        ("dosage", ["x DOSAGE and ADMINISTR notes 2", "DOSAGE AND ADMINISTRATION", "OVERDOSAGE"], 3, 8),
        ("kinetics", ["a", "PHARMACO KINETICS\nx", "b"], 2, 3),
        ("dynamics", ["a", "MECHANISM OF ACTION\nx", "PHARMACOKINETICS\ny"], 2, 3),
    ],
)
def test_locate(spark, section, pages, start, end):
    row = L.locate(paged(spark, *pages), section).first()
    assert (row[f"{section}_start"], row[f"{section}_end"]) == (start, end)


def test_start_page_without_header_is_dropped_unless_kept(spark):
    df = paged(spark, "INDICATIONS....2\n", "no header", "more")
    assert "no header" not in (L.locate(df, "indications").first()["indications_text"] or "")
    assert "no header" in L.locate(df, "indications", keep_headerless=True).first()["indications_text"]


def test_section_seven_ten_is_seven_one(spark):
    df = paged(spark, "7.1 INDICATIONS....2\n7.10 WARNINGS....3\n7.2 DOSAGE....4", "INDICATIONS", "x", "y", "z")
    assert L.locate(df, "indications").first()["indications_end"] == 4


def test_population_last_match_wins(spark):
    df = paged(spark, "Pregnant Women.....2\nPregnancy.....3", "x", "Pregnancy\nbe careful", "Nursing")
    row = L.locate_population(df, "pregnancy").first()
    assert (row["pregnancy_start"], row["pregnancy_end"]) == (3, 4) and "be careful" in row["pregnancy_text"]


def test_population_numbers_in_prose_are_no_stops(spark):
    """Digits within accounts, addresses and amounts aren't the stop headers 7.2 and 7.1.2; a line's own number is."""
    prose = "call 4752 or 17.252.227.210\n7.2.14.140 and 7x2, 7.25, see 7.1.2 there"
    for page, end in ((prose, 3), (prose + "\n 7.2 Other Populations", 2), ("7.1.3. Children", 2)):
        row = L.locate_population(paged(spark, "7.1.1 Pregnant Women\nnone known", page, "x"), "pregnancy").first()
        assert (row["pregnancy_start"], row["pregnancy_end"]) == (1, end), page


def test_long_numbers_are_no_section_numbers(spark):
    """A line of prose that begins with an account's number doesn't end a section; a heading's number does."""
    for line in ("4703443633947811 Achverber auf", "123 Words", "1.234 Words"):
        row = L.locate(paged(spark, *"abcde", "DRUG INTERACTIONS", line, "12.10 OTHER MATTERS", "x"), "interactions").first()
        assert (row["interactions_start"], row["interactions_end"]) == (6, 8), line


def test_contents_entries_equal_patterns(spark):
    """Entries against the patterns that they stand for, over the whole buffer: random contents, numbers and page marks."""
    rng = random.Random(12)
    bits = ["INDICATIONS", "ADVERSE REACTIONS", "DRUG\nINTERACTIONS", "dosage and administration", " ", "\n", " ", "....", "..", ". . ", "7", "7.1", "12", "10.7.1", "x", "word", "3.", "(4)", "DOSAGE ADMINISTRATION", "...8", " 9 ", "1 OTHER....5\n"]
    docs = [[(n, "".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for n in range(1, rng.randrange(2, 13))] for _ in range(250)]
    docs = [[p for p in d if rng.random() < 0.9] or d for d in docs]
    number, gap, dots, blank = r"(\d+\.?\d*)\s+", r"[^\d]*?", r"\.{2,}\s*(\d+)", r"\s+(\d+)(?:\s|$)"
    shapes = {1: number + "{t}" + gap + dots, 2: number + "{t}" + gap + blank, 3: "({t})" + gap + dots, 4: "({t})" + gap + blank}
    titles = [r"INDICATIONS", r"ADVERSE\s+REACTIONS?", r"DRUG\s+INTERACTIONS", L.DOSAGE[0]]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], f"k long, pages {L.PAGES}")
    col = F.col("contents")
    asked = [(n, t, s) for n in (3, 10) for t in titles for s in shapes]
    ahead = F.transform(F.filter(col, lambda e: e["text"].rlike(r"(?i)^\s+\.{2,}\s+(?:DRUG\s+INTERACTIONS)")), lambda e: e["before"])
    got = L.with_entries(df).select("k", F.array(*[F.struct(L._hit(L._within(col, n), t, s).alias("x")) for n, t, s in asked]).alias("hits"), F.transform(L._numbered(col), lambda e: F.struct(e["num"], e["page"])).alias("numbered"), ahead.alias("ahead")).collect()
    seen = 0
    for r in got:
        for (n, t, s), hit in zip(asked, r.hits):
            buffer = "".join(f"\n--- PAGE {m} ---\n{x}\n" for m, x in docs[r.k][:n])
            m = re.search(shapes[s].replace("{t}", t), buffer, re.I | re.A)
            want = None if m is None else (int(m[2]), m[1] if s < 3 else None)
            assert (tuple(hit.x) if hit.x else None) == want, (buffer, t, s)
            seen += want is not None
        whole = "".join(f"\n--- PAGE {m} ---\n{x}\n" for m, x in docs[r.k][:10])
        want = re.findall(r"(?i)(\d+\.?\d*)\s+[A-Z][A-Z\s]+[^\d]*?\.{2,}\s*(\d+)", whole)
        assert [tuple(e) for e in r.numbered] == [(float(a), int(b)) for a, b in want], whole
        assert r.ahead == re.findall(r"(?i)(\d+)\s+\.{2,}\s+(?:DRUG\s+INTERACTIONS)", whole)
    assert seen > 300


def test_outline_and_text_sections():
    pages = [(1, "1 INDICATIONS\nfor pain\n(see 4 DOSAGE AND ADMINISTRATION)\n2 CONTRAINDICATIONS\nallergy")]
    outline = [(0, "1 Indications", 1), (0, "2 Contraindications", 1), (0, "Part II", 2)]
    text, how = X.find_section(pages, outline, "indications")
    assert how == "bookmarks" and text.startswith("INDICATIONS") and "allergy" not in text
    body = "INDICATIONS\n" + "word " * 20 + "\nCONTRAINDICATIONS\n" + "more " * 20
    assert X.find_section([(1, body)], [], "indications") == (body.split("\nCONTRA")[0].strip(), "text search")
    assert X.find_section([(1, "x")], [], "box") == (None, None) and X.find_section([], [(0, "1 Indications", 1)], "indications") == (None, None)
    reference = lambda before: X.surroundings(before + "TITLE", len(before)).is_reference
    assert reference("see section ") and reference("(a ") and not reference("(a) ") and not reference("")


def test_heading_on_the_page_before_and_neighbouring_warnings():
    """A heading at the foot of the page before; warnings and precautions as one; deeper entries inside; the patient part left out."""
    pages = [(1, "intro\n3. WARNINGS"), (2, "be careful\n4 PRECAUTIONS\nslowly"), (3, "Renal\nkidney text (see 5 OVERDOSAGE)\n5 OVERDOSAGE\ncall"), (4, "PART III\nrenal for patients")]
    outline = [(0, "Part I", 1), (1, "3 Warnings", 2), (1, "4 Precautions", 2), (2, "4.1 Renal", 3), (1, "5 Overdosage", 3), (0, "PART III: patients", 4), (1, "Renal", 4)]
    assert [e for _, _, e in X.main_intervals(outline)] == [4, 2, 3, 4, None]
    text, how = X.find_section(pages, outline, "warnings")
    assert how == "bookmarks" and text.startswith("WARNINGS") and text.endswith("(see 5 OVERDOSAGE)\n5") is True
    assert X.subsection_by_outline(X.Layout(pages), outline, "renal").startswith("Renal\nkidney text")
    assert X.subsection_by_outline(X.Layout(pages), outline, "patients") is None


def test_pieces_cover_the_text(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcé \n") for _ in range(rng.randint(0, 400)))) for i in range(50)] + [(50, None), (51, "x" * 400)]
    df = spark.createDataFrame(rows, "i int, t string")
    for i, text, parts in df.select("i", "t", P.chunks(F.col("t"), 60, 10)).collect():
        text = text or ""
        assert (len(parts) == 1) == (len(text) <= 80) and all(len(p) <= 60 for p in parts if len(parts) > 1)
        start = 0
        for n, p in enumerate(parts):
            assert text[start : start + len(p)] == p
            if n + 1 < len(parts):
                tail = text[start + 30 : start + 60].rfind("\n")
                assert len(p) == (30 + tail if tail >= 0 else 60)
                start = max(start + len(p) - 10, start + 1)
        assert start + len(parts[-1]) == len(text)


def test_passages_merge(spark):
    rows = [("aa x bb x cc" + " " * 50 + "X",), ("",), (None,), ("xx",), ("no hit",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.keyword_passages(F.col("t"), "x", 3, 100)).collect()]
    assert got == ["aa x bb x cc\n...\n   X", "", "", "xx", ""]


def test_greedy_is_one_to_one(spark):
    rng = random.Random(2)
    pairs = [(b, i, j, round(rng.random(), 1)) for b in range(3) for i in range(6) for j in range(5)]
    df = spark.createDataFrame(pairs, "b int, i long, j long, sim double").where("sim >= 0.3")
    got = {(r.b, r.i, r.j) for r in M.greedy_pairs(df, ["b"], "i", "j").collect()}
    counts = {r.b: r.tp for r in M.greedy_one_to_one(df, ["b"], "i", "j").collect()}
    for block in range(3):
        left, used = {}, set()
        for sim, i, j in sorted(((s, i, j) for b, i, j, s in pairs if b == block and s >= 0.3), reverse=True):
            if i not in left and j not in used:
                left[i] = j
                used.add(j)
        assert {(i, j) for b, i, j in got if b == block} == set(left.items()) and counts[block] == len(left)
    assert M.greedy_one_to_one(df.limit(0), ["b"], "i", "j").count() == 0


def test_numbered_is_gapless_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(5)
    rows = shared.numbered(df, ["k"], "n").collect()
    assert sorted((r.n, r.k) for r in rows) == [(i + 1, i) for i in range(1000)] and rows[0].__fields__ == ["k", "v", "n"]
    assert shared.numbered(df.limit(0), ["k"], "n").count() == 0


def test_resolution_must_be_single(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="does not resolve"):
        M.resolve_single(left, right, "k").collect()


def test_prefix_anti_has_no_cartesian_product(spark):
    a = spark.createDataFrame([("g", "abc", 1)], "generic string, product string, id int")
    plan = M.prefix_anti(a, a.select("generic", "product"), "generic", "product")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_metric_identities(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"]), ([], ["x"]), ([], [])], "g array<string>, p array<string>")
    out = [tuple(r) for r in S.prf(S.overlap_counts(df, "g", "p")).select("tp", "fp", "fn", "precision", "recall", "f1").collect()]
    assert out == [(1, 1, 1, 0.5, 0.5, 0.5), (0, 1, 0, 0.0, None, None), (0, 0, 0, None, None, None)]


def test_signed_rank_tail(spark):
    z = spark.createDataFrame([(0.0,), (1.959964,)], "z double").select(S.upper_tail(F.col("z"))).collect()
    assert abs(z[0][0] - 1) < 1e-6 and abs(z[1][0] - 0.05) < 1e-5


def test_bootstrap_is_deterministic(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, tp long")
    runs = [B.percentile_interval(B.bootstrap(d, ["tp"], F.col("tp") / 20, 50, 7)).first() for d in (df, df.repartition(7).orderBy(F.desc("id")))]
    assert runs[0] == runs[1] and 0 <= runs[0]["lo"] <= 0.5 <= runs[0]["hi"] <= 1
    assert B.bootstrap(df.where("id < 0"), ["tp"], F.col("tp"), 50, 7).count() == 0


@pytest.mark.parametrize("n, block", [(20, 7), (399, 1 << 16), (1000, 300), (3980, 1 << 16)])
def test_bootstrap_has_the_right_spread(spark, n, block, monkeypatch):
    """10,000 resamples of a share: mean and standard error as the binomial's, whatever the blocks."""
    monkeypatch.setattr(B, "BLOCK", block)
    k = round(0.3 * n)
    df = spark.range(n).select((F.col("id") < k).cast("int").alias("tp"), F.lit(1).alias("one"))
    got = B.bootstrap(df, ["tp", "one"], F.col("tp") / F.col("one"), 10_000, 20261005).agg(F.avg("value"), F.stddev("value"), F.skewness("value")).first()
    p = k / n
    assert abs(got[1] / (p * (1 - p) / n) ** 0.5 - 1) < 0.03 and abs(got[0] - p) < 4 * (p * (1 - p) / n / 10_000) ** 0.5
    assert abs(got[2] - (1 - 2 * p) / (n * p * (1 - p)) ** 0.5) < 0.1


def test_resamples_differ_and_draws_are_even():
    """No two of 2,000 resamples are alike, also for sizes that are powers of two; all rows are drawn equally often."""
    for n in (8, 256, 1000):
        b, i = np.repeat(np.arange(2000), n), np.tile(np.arange(n), 2000)
        drawn = B.ranks(5, b, i, n).astype(int)
        assert drawn.min() >= 0 and drawn.max() < n
        times = np.bincount(drawn, minlength=n)
        assert ((times - 2000) ** 2 / 2000).sum() < n + 5 * (2 * n) ** 0.5
        if n > 8:
            assert len({tuple(sorted(r)) for r in drawn.reshape(2000, n).tolist()}) == 2000


def test_too_many_kinds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(B, "MOST_KINDS", 10)
    with pytest.raises(ValueError):
        B.bootstrap(spark.range(11), ["id"], F.col("id"), 5, 1)


def test_exact_signed_rank(spark):
    """Against all sign patterns; ties, zeros and large groups take the normal approximation."""
    rng = random.Random(4)
    rows = [(n, (k + 1) * rng.choice([-1, 1])) for n in (1, 2, 5, 9, 12) for k in range(n)] + [(100, 0), (101, 1), (101, 1), (101, -1), (102, 0), (102, 3)] + [(103, (k + 1) * (-1) ** (k % 3)) for k in range(60)]
    got = {r.g: r for r in S.signed_rank(spark.createDataFrame(rows, "g int, d int"), "d", "g").collect()}
    for n in (1, 2, 5, 9, 12):
        d = [x for g, x in rows if g == n]
        low = lambda signs: min(sum(k + 1 for k in range(n) if signs[k]), sum(k + 1 for k in range(n) if not signs[k]))
        seen = low([x > 0 for x in d])
        p = sum(low(signs) <= seen for signs in itertools.product([False, True], repeat=n)) / 2**n
        assert got[n].w == seen and got[n].p == pytest.approx(min(1.0, p))
    assert (got[100].n, got[100].p) == (0, 1.0) and got[101].z is not None and got[102].n == 1
    assert got[103].n == 60 and 0 < got[103].p < 1


def test_exact_quantiles_of_one_group(spark):
    """Nearly all rows in one group, ties, nulls, one value, and no group at all."""
    rng = random.Random(9)
    rows = [("hot", rng.randrange(60)) for _ in range(500)] + [("one", 7), ("two", 1), ("two", 4), (None, 3), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = {r.g: tuple(r)[1:] for r in R.quartiles(df, "v", "g").collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    assert got == {g: (min(v), *np.quantile(v, [0.25, 0.5, 0.75]).tolist(), max(v)) for g, v in groups.items() if v}
    assert {r.g: r.upper_median for r in R.upper_median(df, "v", "g").collect()} == {g: sorted(v)[len(v) // 2] for g, v in groups.items() if v}
    every = [v for _, v in rows if v is not None]
    assert R.quantiles(df, "v", {"a": 0.1, "b": 0.99}).first() == tuple(np.quantile(every, [0.1, 0.99]).tolist())


def test_micro_f1_of_zeros_is_undefined(spark):
    df = spark.createDataFrame([(0, 2, 3)], "tp int, fp int, fn int")
    assert S.micro(df).first()["f1"] is None and S.prf(df).first()["f1"] == 0.0


@pytest.mark.parametrize("order", [1, -1])
def test_one_key_with_all_rows(spark, order):
    """Running maxima and sums go from range to range: one user has all intervals."""
    rng = random.Random(order)
    rows = [(7 if n else None, s := rng.randrange(3000), s + rng.randrange(8)) for n in range(600)][::order] + [(7, 5, 5)] * 9
    islands = []
    for u in (None, 7):
        reach = None
        for _, s, e in sorted(r for r in rows if r[0] == u):
            if reach is None or s > reach:
                islands.append([u, s, e, 0])
            reach = e if reach is None else max(reach, e)
            islands[-1][2], islands[-1][3] = max(islands[-1][2], e), islands[-1][3] + 1
    got = M.merge_intervals(spark.createDataFrame(rows, "u int, s int, e int"), ["u"], "s", "e")
    assert sorted(map(list, got.collect()), key=str) == sorted(islands, key=str)


def test_pages_are_pushed_to_the_file_source(spark, tmp_path):
    """A decoder that notes what it decodes sees only the wanted pages, by options and by pushed filters."""
    for n in range(5):
        (tmp_path / f"{n}.txt").write_text(f"a{n}\fb{n}\fc{n}\fd{n}")
    (tmp_path / "odd.pdf").write_text("x")
    reader = source.PushingReader({"path": f"file://{tmp_path}", "suffix": "txt", "decoder": "text", "partition_bytes": "25"})
    filters = [source.GreaterThan(("page_num",), 1), source.LessThanOrEqual(("page_num",), 3), source.EqualTo(("key",), "1.txt")]
    assert list(reader.pushFilters(filters)) == filters and (reader.first, reader.last) == (2, 3)
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 1]
    assert [r[:3] for r in reader.read(parts[2])] == [("4.txt", 2, "b4"), ("4.txt", 3, "c4")]
    rows = source.read_pages(spark, f"file://{tmp_path}", "txt", "text", 4)
    assert sorted(r.text for r in rows.collect()) == [f"d{n}" for n in range(5)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert {(r.key, r.text) for r in source.read_pages(spark, f"file://{tmp_path}", "txt", "text").where("page_num = 3").collect()} == {(f"{n}.txt", f"c{n}") for n in range(5)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "empty").mkdir()
    assert source.read_pages(spark, f"file://{tmp_path}/empty", "txt", "text").count() == 0
    assert files.TextDecoder().pages(b"a\fb\fc", range(2, 2**31)) == [(2, "b"), (3, "c")] and files.TextDecoder().pages(b"a\fb", range(1, 1)) == []


def test_pdf_pages_through_a_stub(monkeypatch):
    """PyPDF2's calls, with a stub of it: only wanted pages are extracted, destinations that can't be resolved are left out."""
    import sys
    import types

    seen = []

    class Page:
        def __init__(self, n):
            self.n = n

        def extract_text(self):
            seen.append(self.n)
            return f"text {self.n}" if self.n != 2 else None

    class PdfReader:
        def __init__(self, stream):
            assert stream.read() == b"pdf"
            self.pages = [Page(n) for n in (1, 2, 3)]
            self.outline = [types.SimpleNamespace(title=" One  part"), [types.SimpleNamespace(title="bad")]]

        def get_destination_page_number(self, entry):
            if entry.title == "bad":
                raise KeyError
            return 1

    monkeypatch.setitem(sys.modules, "PyPDF2", types.SimpleNamespace(PdfReader=PdfReader))
    decoder = files.PdfDecoder()
    assert decoder.pages(b"pdf", range(2, 9)) == [(2, ""), (3, "text 3")] and seen == [2, 3]
    assert decoder.pages(b"pdf")[0] == (1, "text 1") and list(files.flatten(decoder.outline(b"pdf"))) == [(0, "One part", 2)]


def test_resume_after_a_crash(spark, tmp_path):
    path, cols = str(tmp_path / "r.jsonl"), ["Source Path", "Brand Name"]
    lines = [json.dumps({"Source Path": f"{i}.pdf", "Brand Name": "ERROR" if i == 1 else "x"}) for i in range(4)]
    with open(path, "w") as f:
        f.write("\n".join(lines)[:-7])
    good, bad = records.split_bad(records.read_records(spark, path, cols).cache())
    assert good.count() == 3 and bad.count() == 1
    entries = spark.createDataFrame([(f"{i}.pdf",) for i in range(6)], "key string")
    assert [r.key for r in records.pending(entries, good).collect()] == ["3.pdf", "4.pdf", "5.pdf"]
    assert [r.key for r in records.pending(entries, good, retry=True, limit=2).collect()] == ["1.pdf", "3.pdf"]


def test_rewrite_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("1", "b")], ["ID", "Brand Name"])
    for _ in range(2):
        records.rewrite_records(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert records.ordered(df.select("Brand Name", F.lit(1).alias("zz"), "ID")).columns == ["ID", "Brand Name"]
    assert records.write_field_tables(df, str(tmp_path / "f"))
    records.write_csv(spark.createDataFrame([("007",)], ["din"]), str(tmp_path / "c"))
    assert records.read_csv(spark, str(tmp_path / "c"), "din string").first()["din"] == "007"
    records.append_records(df, str(tmp_path / "a"))
    records.append_records(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 2
    assert [f.record for f in C.RECORD_FIELDS][0] == "ID" and len(C.record_order()) == 25


def corpus(root):
    for name, text in {"c1/d1/a.PDF": "one\f\fthree\n# Title\n## Sub", "c1/d2/a.pdf": "x", "c1/d2/b.txt": "no"}.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)


def test_files(spark, tmp_path):
    corpus(tmp_path)
    found = files.discover(spark, f"file://{tmp_path}").orderBy("key").collect()
    assert [(r.key, r.filename) for r in found] == [("c1/d1/a.PDF", "a.PDF"), ("c1/d2/a.pdf", "a.pdf")]
    docs = files.decode(files.read_files(spark, f"file://{tmp_path}"), files.TextDecoder()).orderBy("key")
    row = docs.first()
    assert [(p.page_num, p.text.split("\n")[0]) for p in row.pages] == [(1, "one"), (3, "three")]
    assert [(o.depth, o.title, o.page) for o in row.outline] == [(0, "Title", 3), (1, "Sub", 3)]
    assert docs.select(files.page_text(F.col("pages"), (0, 7))).first()[0] == "one"
    assert files.page_range is not None and files.first_entries(docs, "key", {"t": "^title"}).first()["page"] == 3


def test_sections_hold_one_slice_at_a_time(monkeypatch):
    """However large a batch is, at most SLICE_BYTES of its pages are Python objects; nulls, slices of a batch and documents above the bound are kept."""
    import pyarrow as pa

    monkeypatch.setattr(X, "SLICE_BYTES", 100)
    pages = pa.array([None, [], *[[{"page_num": n, "text": str(k) * (k % 7 * 30)} for n in (1, 2)] for k in range(40)]], pa.list_(pa.struct([("page_num", pa.int32()), ("text", pa.string())])))
    outlines = pa.array([None if k % 2 else [{"depth": 0, "title": str(k), "page": k}] for k in range(42)], pa.list_(pa.struct([("depth", pa.int32()), ("title", pa.string()), ("page", pa.int32())])))
    held, seen = [], X._rows
    monkeypatch.setattr(X, "_rows", lambda lists, *names: held.append((names, seen(lists, *names))) or held[-1][1])
    for skip in (0, 5):
        got = X._sliced(pages[skip:], outlines[skip:], lambda p, o: repr((p, o)), pa.string()).to_pylist()
        plain = lambda v, *names: [tuple(r[n] for n in names) for r in v or []]
        assert got == [repr((plain(p, "page_num", "text"), plain(o, "depth", "title", "page"))) for p, o in zip(pages[skip:].to_pylist(), outlines[skip:].to_pylist())]
    parts = [rows for names, rows in held if "text" in names]
    assert len(parts) > 20 and all(sum(len(t) for p in rows for _, t in p) <= 100 or len(rows) == 1 for rows in parts)


def test_field_texts(spark, tmp_path):
    corpus(tmp_path)
    docs = files.decode(files.read_files(spark, f"file://{tmp_path}"), files.TextDecoder())
    out = P.field_texts(docs.select("key", "pages", "outline")).collect()
    assert len(out) == 2 and set(out[0]["how"]) == set(P.HEADINGS)


def test_broken_file_keeps_its_error(spark, tmp_path):
    class Bad(files.TextDecoder):
        def pages(self, content):
            raise ValueError("broken")

    corpus(tmp_path)
    rows = files.decode(files.read_files(spark, f"file://{tmp_path}"), Bad()).collect()
    assert all(r.error == "ValueError: broken" and not r.pages for r in rows)


def test_ingest_sees_each_file_once(spark, tmp_path):
    root, out, check = (f"file://{tmp_path / n}" for n in ("in", "out", "check"))
    corpus(tmp_path / "in")
    for extra in ("", "c2/n/z.pdf"):
        if extra:
            os.makedirs(tmp_path / "in/c2/n")
            (tmp_path / "in" / extra).write_text("new")
        ingest.ingest(spark, root, out, check, files.TextDecoder(), lambda d: d.select("key", "sha256"))
    rows = ingest.read_ingested(spark, out).collect()
    assert sorted(r.key for r in rows) == ["c1/d1/a.PDF", "c1/d2/a.pdf", "c2/n/z.pdf"] and len({r.batch for r in rows}) == 2


def test_answers_are_asked_again_with_the_reason(spark):
    table = spark.createDataFrame(
        [("a", "f", 0, 1, "asthma, fever", "stop"), ("b", "f", 0, 1, "In summary it helps", "stop"), ("b", "f", 0, 2, "cough, pain, hea", "length"), ("c", "f", 0, 1, None, "stop")],
        "key string, field string, chunk int, attempt int, text string, finish_reason string",
    )
    requests = spark.createDataFrame([(k, "f", 0, "p") for k in "abc"], "key string, field string, chunk int, prompt string")
    got = {r.key: (r.value, r.attempt) for r in answers.validated(requests, answers.RecordedAnswers(table)).collect()}
    assert got == {"a": ("asthma, fever", 1), "b": ("cough, pain", 2), "c": ("EXTRACTION_FAILED", 3)}


class Moody:
    """Notes every call in a file. Odd requests get a list at even calls of theirs and prose at odd ones; the rest always get prose."""

    def __init__(self, folder, fail_at=None):
        self.folder, self.fail_at = str(folder), fail_at

    def calls(self):
        return sorted(os.listdir(self.folder))

    def answer(self, requests, attempt):
        folder, fail_at = self.folder, self.fail_at

        def run(batches):
            for pdf in batches:
                texts = []
                for key in pdf["key"]:
                    if key == fail_at:
                        raise RuntimeError("the model is gone")
                    before = sum(f.startswith(f"{key}-") for f in os.listdir(folder))
                    open(f"{folder}/{key}-{attempt}-{random.random()}", "w").close()
                    texts.append("cough, fever" if before % 2 and int(key) % 2 else "In summary it helps. And More")
                pdf["text"], pdf["finish_reason"] = texts, "stop"
                yield pdf

        return requests.mapInPandas(run, "key string, field string, chunk int, prompt string, text string, finish_reason string")


def test_every_attempt_is_asked_once(spark, tmp_path):
    """Two actions on the result, and answers that change from call to call: no row is lost, none doubled, none asked twice."""
    requests = spark.createDataFrame([(str(k), "f", None, "p") for k in range(10)], "key string, field string, chunk int, prompt string")
    model = Moody(tmp_path)
    got = answers.validated(requests, model)
    want = {str(k): ("cough, fever", 2) if k % 2 else (answers.FAILED, 3) for k in range(10)}
    for _ in range(2):
        assert {r.key: (r.value, r.attempt) for r in got.collect()} == want and got.count() == 10
    assert [c.split("-")[:2] for c in model.calls()] == sorted([str(k), str(a)] for k in range(10) for a in range(1, 3 if k % 2 else 4))


def test_a_ledger_is_gone_on_with(spark, tmp_path):
    """The model dies at one request of the first attempt. The next run asks only what has no answer yet; progress is told by slice."""
    (tmp_path / "calls").mkdir()
    requests = spark.createDataFrame([(str(k), "f", 0, "p") for k in range(10)], "key string, field string, chunk int, prompt string")
    told = []
    book = lambda: answers.Ledger(spark, f"file://{tmp_path}/ledger", 4, lambda a, p: told.append((a, p)))
    with pytest.raises(Exception, match="gone"):
        answers.validated(requests, Moody(tmp_path / "calls", "4"), ledger=book())
    kept = {r.key for r in spark.read.parquet(f"file://{tmp_path}/ledger/attempt-001").collect()} if told else set()
    before = len(Moody(tmp_path / "calls").calls())
    got = answers.validated(requests, Moody(tmp_path / "calls"), ledger=book())
    assert got.count() == 10 and {r.key for r in got.collect()} == {str(k) for k in range(10)}
    firsts = [c.split("-")[0] for c in Moody(tmp_path / "calls").calls() if c.split("-")[1] == "1"]
    assert all(firsts.count(k) == 1 for k in kept) and len(firsts) >= 10 and before <= len(firsts)
    again = len(Moody(tmp_path / "calls").calls())
    answers.validated(requests, Moody(tmp_path / "calls"), ledger=book()).collect()
    assert len(Moody(tmp_path / "calls").calls()) == again
    last = [p for a, p in told if a == 3]
    assert last and last[-1].done == last[-1].total and last[-1].rate > 0 and last[-1].seconds_left == 0 and last[-1].percent == 100


def test_progress():
    p = ledger.Progress(0, 0, 0.0, 10)
    assert p.rate is None and p.seconds_left is None and p.percent == 0
    p = p.plus(4, 1, 2.0)
    assert (p.done, p.failed, p.rate, p.seconds_left, p.percent) == (4, 1, 2.0, 3.0, 40.0) and ledger.Progress(0, 0, 1.0, 0).percent == 100


def test_budgets_and_settings(monkeypatch):
    b = answers.Budget()
    assert b.spend("429") == 30 and b.spend("timed out") == 5 and b.spend("timed out") is None and b.spend("x") == 5
    monkeypatch.setenv("DOSSIER_TIMEOUT", "9")
    assert answers.Settings.from_env().timeout == 9.0 and answers.Budget.reason("timed out") == "timeout"


def test_lookup_fetches_distinct_keys_once(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    known = spark.createDataFrame([("b", "old", None)], "k string, value string, error string")
    fetch = lambda k: k.upper()
    got = {r.k: r.value for r in lookups.lookup(keys, "k", known, fetch, pace=0).collect()}
    assert got == {"a": "A", "b": "old"}

    def fail(k):
        raise OSError("down")

    assert lookups.lookup(keys, "k", known, fail, attempts=1, pace=0).where("error is not null").count() == 1


def test_similarity(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("a b", "c d")], "x string, y string")
    assert [r[0] for r in df.select(lookups.similarity(F.col("x"), F.col("y"))).collect()] == [1.0, 0.0]


def test_native_operators_have_no_python(spark, small):
    from dossier.plans import registry

    for name in ("normalize_list_documents", "set_prf_micro", "prioritised_match", "corpus_profile", "locate_all_sections"):
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


@pytest.fixture
def stub():
    """A chat endpoint that answers by field: lists, one refusal first, an answer that is cut off, an error."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            prompt = body["messages"][-1]["content"]
            text, reason = "nausea, rash", "stop"
            if "ready" in prompt:
                text = " ready\n"
            elif "first refused" in prompt and "was refused" not in prompt:
                text = "In summary the text you provided lists some events."
            elif "too long" in prompt:
                text, reason = "cough, pain, hea", "length"
            elif "broken" in prompt:
                self.send_response(500)
                self.end_headers()
                return
            data = json.dumps({"choices": [{"message": {"content": text}, "finish_reason": reason}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen
    server.shutdown()


def test_http_answers_by_field(spark, stub):
    url, seen = stub
    texts = [("a", "plain section"), ("b", "first refused"), ("c", "too long"), ("d", "broken"), ("e", None)]
    docs = spark.createDataFrame([(k, 0, t) for k, t in texts], "key string, chunk int, section string")
    requests = answers.requested(docs, "adverse_events", "section").drop("section")
    http = answers.HttpAnswers(answers.Settings(endpoint=url, model="m"), 2, {"rate": (2, 0.0), "timeout": (2, 0.0), "other": (2, 0.0)})
    assert http.preflight() == (True, "ready") and not answers.HttpAnswers(answers.Settings(endpoint="http://127.0.0.1:9/v1")).preflight()[0]
    got = {r.key: (r.value, r.reason, r.attempt) for r in answers.validated(requests, http).collect()}
    assert got["a"] == got["e"] == ("nausea, rash", "ok", 1) and got["b"] == ("nausea, rash", "ok", 2) and got["c"] == ("cough, pain", "ok", 1)
    assert got["d"][0] == "EXTRACTION_FAILED"
    lists = [b for b in seen if "adverse events" in b["messages"][-1]["content"]]
    assert lists and all(b["max_tokens"] == 700 and b["model"] == "m" and b["messages"][0]["role"] == "system" for b in lists) and {b["temperature"] for b in lists} == {0.1, 0.0}


def test_every_field_has_its_call(spark):
    docs = spark.createDataFrame([("k", "x" * 50, None)], "key string, section string, drug string")
    for field, call in answers.CALLS.items():
        row = answers.requested(docs, field, "section", "drug", limit=20).first()
        assert row.prompt.count("x" * 20) == 1 and "x" * 21 not in row.prompt and "{" not in row.prompt and row.system == call.system and row.field == field
    assert len(answers.CALLS) == 20 and sum(c.is_list for c in answers.CALLS.values()) == 4
    assert "NO INFORMATION" in answers.CALLS["pregnancy_status"].template


def test_documents_are_fetched_with_digest_and_first_page(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"first page\x0csecond")
    keys = spark.createDataFrame([(f"file://{tmp_path}/a.txt",), (f"file://{tmp_path}/none",)], "url string")
    fetch = lookups.fetch_document(lambda data: data.split(b"\x0c")[0].decode())
    rows = {r.url[-5:]: r for r in lookups.lookup(keys, "url", None, fetch, attempts=1, pace=0).withColumn("d", lookups.fetched_document(F.col("value"))).collect()}
    assert (rows["a.txt"].d.sha256, rows["a.txt"].d.text) == (hashlib.sha256(b"first page\x0csecond").hexdigest(), "first page")
    assert rows["/none"].d is None and rows["/none"].error


def test_json_document_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("é\n", 2, "x")], "k string, n int, o string")
    records.write_json(df, f"file://{tmp_path}/doc")
    parts = [p for p in os.listdir(tmp_path / "doc") if p.startswith("part")]
    assert len(parts) == 1 and json.loads((tmp_path / "doc" / parts[0]).read_text()) == [{"k": "a", "n": 1, "o": None}, {"k": "é\n", "n": 2, "o": "x"}]
    assert sorted(map(tuple, records.read_json(spark, f"file://{tmp_path}/doc", "k string, n int, o string").collect())) == [("a", 1, None), ("é\n", 2, "x")]
    with pytest.raises(ValueError):
        records.write_json(df, f"file://{tmp_path}/doc", limit=1)


def test_removal_is_checked(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k int, v string")
    assert sorted(map(tuple, M.remove_duplicates(df, "k", [1], F.col("v") == "y").collect())) == [(1, "x"), (2, "x")]
    for expected in ([], [2], [1, 2]):
        with pytest.raises(Exception, match="more than once: 1"):
            M.remove_duplicates(df, "k", expected, F.col("v") == "y").collect()


def test_agreement_of_links(spark):
    rows = [
        ("apo-drug 10mg-2", "Apo-Drug", "Apotex Inc.", "APO-DRUG TABLETS", "APOTEX LIMITED", ["10.0"]), ("drug 2.5", "Drug", "Teva Canada", "Other", "Teva", ["5"]),
        ("drug", "Drug", "Canada Inc", "drug", "Canada Ltd", None), ("x 5", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, brand string, company string, fb string, fc string, fs array<string>")
    got = [tuple(r)[-4:] for r in M.agreement(df, "id", "brand", "company", "fb", "fc", "fs").collect()]
    assert got == [(True, True, True, True), (True, False, False, False), (False, True, True, False), (False, False, False, False)]


def test_names_found_on_the_page(spark):
    rows = [("Apo-Drug", "Apotex Inc.", "APO DRUG\ntablets, Apotex"), ("Apo-Drug", "Other Ltd", "apo drug by Apotex"), ("Drug", "Inc", "the drug"), (None, "x", "x"), ("a", "b", None)]
    from dossier.functions import text

    df = spark.createDataFrame(rows, "brand string, company string, page string")
    assert [r[0] for r in df.select(text.names_found(F.col("brand"), F.col("company"), F.col("page"))).collect()] == [True, False, True, False, False]


def test_answers_are_judged_once(spark):
    """The result and later attempts read what was judged; no attempt's list contract is worked out again."""
    requests = spark.createDataFrame([(k, "list", 0) for k in range(6)], "key long, field string, chunk int")
    said = [(k, "list", 0, a, "nausea, rash" if a > k % 4 else "I think. So it is", "stop") for k in range(6) for a in (1, 2, 3)]
    out = answers.validated(requests, answers.RecordedAnswers(spark.createDataFrame(said, "key long, field string, chunk int, attempt int, text string, finish_reason string")))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.key: (r.attempt, r.value) for r in out.collect()} == {k: (min(k % 4 + 1, 3), "nausea, rash" if k % 4 < 3 else answers.FAILED) for k in range(6)}
