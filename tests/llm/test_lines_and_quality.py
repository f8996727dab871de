import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from rivulet.llm import linededup, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOWER)


def deduped(docs, least):
    seen = Counter(k for i, t in {(i, t or "") for i, t in docs} for k in {key(x) for x in t.split("\n")} if k)
    often = {k for k, n in seen.items() if n >= least}
    return Counter((i, len((t or "").split("\n")), sum(key(x) in often for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in often)) for i, t in docs)


def check_lines(spark_frame, docs, least):
    out = linededup.drop_frequent_lines(spark_frame, min_docs=least)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect())
    assert got == deduped(docs, least)


def test_line_dedup_against_brute_force(frame, rng):
    lines = ["Common Line", " common line\t", "COMMON LINE", "", "  ", "É é", "rare"] + [f"line {k}" for k in range(20)]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for k in range(200)]
    check_lines(frame(docs, "doc_id long, text string"), docs, 10)


def test_line_dedup_edges(odd, frame, no_documents):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for least in (1, 2):
        check_lines(odd, docs, least)
    assert linededup.drop_frequent_lines(odd).columns == [*odd.columns, "n_lines", "n_dropped"]
    assert linededup.drop_frequent_lines(no_documents).count() == 0
    # A line in nine documents stays, in ten it goes; a document may lose everything and stays as ''.
    for n, left in ((9, {"x"}), (10, {""})):
        out = linededup.drop_frequent_lines(frame([(k, "x") for k in range(n)], "doc_id long, text string"))
        assert {r["text"] for r in out.collect()} == left
    # One document that repeats a line is one document; an exactly repeated row too.
    assert linededup.drop_frequent_lines(frame([(1, "x\n" * 20)] * 12, "doc_id long, text string")).where("n_dropped > 0").count() == 0


def statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    with_word = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(with_word) - len(set(with_word)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_quality_statistics_against_brute_force(frame, odd, rng):
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) + rng.choice(["", "\n", " # % |"]) + "x\nx" for n in range(60)]
    out = quality.assess(frame(list(enumerate(texts)), "doc_id long, text string"))
    for r in out.collect():
        assert tuple(r[n] for n in NAMES) == statistics(texts[r["doc_id"]])
    for r in quality.assess(odd).collect():
        assert tuple(r[n] for n in NAMES) == statistics(r["text"])


def test_quality_verdicts(frame, no_documents, rng):
    good = "\n".join(" ".join(f"word{rng.randrange(10_000)}" for _ in range(12)) + "." for _ in range(8))
    docs = {
        0: good, 1: "\n".join(" | ".join(f"menu{rng.randrange(999)}" for _ in range(12)) for _ in range(8)), 2: re.sub(r"(\w+)", r"\1%%%***", good), 3: re.sub(r"(\w+)", r"\1!!", good), 4: "a b c " * 40,
        5: "too short.", 6: good + "\nLicensed under the Apache License.", 7: good + "\n" + good.replace("word", "term"), 8: None,
    }
    out = {r["doc_id"]: r for r in quality.assess(frame(list(docs.items()), "doc_id long, text string")).collect()}
    assert {k for k, r in out.items() if r["kept"]} == {0, 6, 7}
    assert {k for k, r in out.items() if r["base_failed"]} == {4, 5, 8}
    assert out[6]["clean_text"] == good and out[0]["clean_text"] == good
    assert quality.assess(no_documents).count() == 0


def test_line_dedup_and_quality_run_no_python(odd):
    for out in (linededup.drop_frequent_lines(odd), quality.assess(odd)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_kept_digest(frame):
    out = linededup.drop_frequent_lines(frame([(1, "é\nb")], "doc_id long, text string")).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    assert out.first()["h"] == hashlib.sha256("é\nb".encode()).hexdigest()


def test_line_rules(frame):
    bad = [
        "Home | About | News | Contact", "Home", " next page » ", "Startseite · Kontakt · Impressum", "Read more...", "ANTERIOR / SIGUIENTE", "The council met on Monday and…", "We value [...]",
        "This site uses cookies to work", "Diese Seite verwendet Cookies.", "© 2020 Tous droits réservés", "TODOS LOS DERECHOS RESERVADOS", "#### $$$$", "Wow!!!!", "DATENSCHUTZERKLÄRUNG lesen",
    ]
    good = ["", "Home is where the heart is.", "He came back to the top of the hill", "All rights reserved " + "was the phrase that they wrote about at length, " * 10, "More news about the search", "One | two"]
    out = frame([(k, x) for k, x in enumerate(bad + good)], "doc_id long, text string").withColumn("fine", quality.line_passes(F.col("text"))).orderBy("doc_id").collect()
    assert [r["text"] for r in out if not r["fine"]] == bad


def test_columns_with_clashing_names(frame):
    docs = frame([(1, "a b c", "mine", 7)], "doc_id long, text string, kept string, n_words int")
    (row,) = quality.assess(docs).collect()
    assert row["kept"] is False and row["n_words"] == 3 and sorted(row.asDict()) == sorted([*docs.columns, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "kept_share", "base_failed"])


def test_salted_keys_are_not_broadcast_by_the_size_of_the_keys(spark, small_broadcasts):
    docs = spark.range(0, 400, 1, 4).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 99), x -> concat('line ', (id div 2) * 100 + x)), '\\n') AS text")
    out = linededup.drop_frequent_lines(docs, min_docs=2).agg(F.sum("n_lines"), F.sum("n_dropped")).first()
    assert tuple(out) == (40_000, 40_000)
