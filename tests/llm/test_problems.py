"""The training-data operators against brute force, known cases and awkward inputs."""

import base64
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from notebrook.llm import encoding, grammars, language, leaks, overlap, prose, syntax, tokenize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEGMENTS = "segments array<struct<segment_id int, has_code boolean, cells array<struct<type string, content array<string>>>>>"


# ---- 1 overlap


def books(spark, rows):
    made = [(i, "src", split, [(0, True, [("code", lines)])] if lines is not None else None, "clash") for i, split, lines in rows]
    return spark.createDataFrame(made, f"notebook_id bigint, dataset string, split string, {SEGMENTS}, class string")


@pytest.mark.parametrize("part_rows", [1, 2000])
def test_overlap_equals_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(overlap, "PART_ROWS", part_rows)
    rng = random.Random(3)
    common = [f"import m{i}" for i in range(4)]
    base = [[rng.choice(common) for _ in range(2)] + [f"x{b}_{i} = {i}" for i in range(rng.randint(3, 14))] for b in range(12)]
    rows = []
    for i in range(120):
        lines = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            lines[rng.randrange(len(lines))] = rng.choice([*lines, f"y{i} = 1"])
        rows.append((i, rng.choice(["train", "train", "valid", "test", None]), [f"  {x}  # note {i}" if rng.random() < 0.3 else x for x in lines]))
    rows += [(500, "train", []), (501, "test", []), (502, "test", None), (503, "valid", ["", "# only"]), *rows[:5]]
    bag = lambda lines: Counter(re.sub(r"\s+|#.*", "", x) for x in lines or [] if re.sub(r"\s+|#.*", "", x))
    want = set()
    for i, s, a in rows:
        for j, t, b in rows:
            if s == "train" and t in ("valid", "test"):
                x, y = bag(a), bag(b)
                if x and y and sum((x & y).values()) / sum((x | y).values()) >= 0.7:
                    want.add((min(i, j), max(i, j)))
    got = {tuple(r) for r in overlap.found_pairs(books(spark, rows)).collect()}
    assert want and got == want


def test_overlap_empty_and_copies(spark):
    assert overlap.found_pairs(books(spark, [])).count() == 0
    same = [(i, "train" if i % 2 else "test", ["a = 1", "b = '#x'", "c = 3"]) for i in range(10)]
    assert overlap.found_pairs(books(spark, same)).count() == 25
    report = overlap.overlap_report(books(spark, same)).collect()
    assert [(r["split"], r["notebooks"], r["pairs"], r["exact_pairs"]) for r in report] == [("test", 5, 25, 25)]


def test_comment_pattern(spark):
    lines = ["x = '#1'  # c", "s = \"a'#b\" # d", "# all", "it's # fine", "y = " + "'a'" * 3000 + "# end", "z = '" + "\\\\'" * 2000]
    got = spark.createDataFrame([(lines,)], "c array<string>").select(overlap.bare_lines(__import__("pyspark.sql.functions", fromlist=["col"]).col("c"))).first()[0]
    assert got[:3] == ["x='#1'", "s=\"a'#b\"", "it's"]
    assert len(got) == 5


# ---- 2 language

TEXTS = {
    "en": "The quick brown fox jumps over the lazy dog while the old file remains as it was",
    "de": "Der schnelle braune Fuchs springt über den faulen Hund und die alte Datei bleibt liegen",
    "fr": "Le renard brun saute par dessus le chien paresseux et le vieux fichier reste en place",
    "ru": "Быстрая коричневая лиса прыгает через ленивую собаку а старый файл остаётся прежним",
    "zh": "为了让结果保持稳定我们只保留表中的记录然后把所有内容保存到磁盘上",
}


def fitted():
    rng = np.random.default_rng(1)
    lines = []
    for name, text in TEXTS.items():
        words, _ = language.line_words(text)
        for _ in range(12):
            lines.append((list(rng.permutation(words)[: max(4, len(words) - 2)]), language.LANGUAGES.index(name)))
    return language.LanguageField().fit(lines, steps=30)


def test_labels_are_read():
    assert [language.canonical(x) for x in ("EN", "en-US", "deu", "ger", " pt_BR ", "", None, "xx", "und", "zho")] == ["en", "en", "de", "de", "pt", None, None, None, None, "zh"]
    assert language.line_words("`code here` <b>ab</b> https://x.example.org/page cd")[1] == 4
    assert language.line_words(None) == ([], 0)


def test_labels_column(spark):
    from pyspark.sql import functions as F

    values = ["EN", "en-US", "deu", " pt_BR ", "", None, "xx", "zho"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "l string").select(language.canonical_column(F.col("l"))).collect()]
    assert got == [language.canonical(v) for v in values]


def test_forward_backward_sums_to_one_and_equals_enumeration():
    rng = np.random.default_rng(0)
    e, tr = rng.normal(size=(1, 3, 4)), rng.normal(size=(4, 4))
    gamma, pairs = language.forward_backward(e, np.ones((1, 3), bool), tr, want_pairs=True)
    want = np.zeros((3, 4))
    total = 0
    for a in range(4):
        for b in range(4):
            for c in range(4):
                p = np.exp(e[0, 0, a] + e[0, 1, b] + e[0, 2, c] + tr[a, b] + tr[b, c])
                total += p
                for t, y in enumerate((a, b, c)):
                    want[t, y] += p
    assert np.allclose(gamma[0], want / total)
    assert np.isclose(pairs.sum(), 2)


def test_wrong_and_mixed_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "fitted", lambda cells: fitted())
    en, de, ru = TEXTS["en"], TEXTS["de"], TEXTS["ru"]
    cells = spark.createDataFrame(
        [
            ("a", "markdown", [en, "***"], "en-US", 1), ("b", "markdown", [de], "en", 1), ("c", "markdown", [en, None, ru], "en", 1), ("d", "markdown", None, None, 1),
            ("e", "code", [de], None, 1), ("f", "markdown", [], "", 1), ("b", "markdown", [de], "en", 1), ("g", "markdown", [de], None, 1), ("h", "markdown", [""], "zz", 1),
        ],
        "_id string, type string, content array<string>, lang string, label int",
    )
    parts = spark.createDataFrame([("s", [de, "$CODE$", en]), ("t", [en]), ("u", None)], "_id string, prompts array<string>")
    got = {tuple(r) for r in language.wrong_labels(cells, parts).collect()}
    assert got == {("b", -1, "de"), ("c", 0, "en"), ("c", 2, "ru"), ("g", -1, "de"), ("s", 0, "de"), ("s", 2, "en")}
    assert language.wrong_labels(cells.limit(0), parts.limit(0)).count() == 0


def test_fit_on_noisy_labels(spark):
    """The label of every seventh cell is wrong and one line stands in hundreds of cells; the sample and the fit are the real ones."""
    rng, heading, rows, truth = random.Random(3), "Looking at the raw values", [], set()
    langs = [x for x in TEXTS if x != "zh"]
    words = {x: TEXTS[x].split() for x in langs}
    for i in range(1500):
        lang = "en" if i % 2 else langs[i // 2 % len(langs)]
        lines = [" ".join(rng.choices(words[lang], k=8)) for _ in range(2)]
        if lang == "en" and i % 3:
            lines[0] = heading
        label = langs[i // 7 % len(langs)] if i % 7 == 0 else lang
        if label != lang:
            truth.add((f"c{i}", -1, lang))
        rows.append((f"c{i}", "markdown", lines, label))
    cells = spark.createDataFrame(rows, "_id string, type string, content array<string>, lang string")
    got = {tuple(r) for r in language.wrong_labels(cells, spark.createDataFrame([], "_id string, prompts array<string>")).collect()}
    assert len(got & truth) >= 0.95 * max(len(truth), len(got))


def test_cleaned_keeps_the_language_of_a_common_line():
    common, other = "loading and cleaning the raw data".split(), "veri yükleme ve temizleme işi".split()
    rows = [(common, Counter({0: 380, 8: 20})), (other, Counter({8: 9, 0: 3}))]
    rows += [(f"some other words of this text {i}".split(), Counter({0: 1})) for i in range(30)]
    rows += [(f"bu metnin başka kelimeleri {i}".split(), Counter({8: 1})) for i in range(5)]
    found = {tuple(w): y for w, y in language.cleaned(rows)}
    assert found[tuple(common)] == 0 and found[tuple(other)] == 8


def test_fit_survives_an_empty_table(spark):
    empty = spark.createDataFrame([], "_id string, type string, content array<string>, lang string")
    assert language.fitted(empty).shares([["a"]]).shape == (1, len(language.LANGUAGES))


# ---- 4 prose


def test_spans_by_language():
    code = 'x = "a b c d e"  # one\n# two\n\n# three\ndef f():\n    """Doc of it."""\n    return \'it\\\'s\'\n!echo "not this one at all"\n'
    assert list(prose.code_spans(code, "python")) == [("comment", "# one\n# two"), ("literal", "a b c d e"), ("literal", "Doc of it."), ("comment", "# three"), ("literal", "it's")]
    assert [t for _, t in prose.code_spans("#= a #= b =# c =#\ny = 'a'\nz = x' * \"s\"", "julia")] == ["#= a #= b =# c =#", "s"]
    assert [t for _, t in prose.code_spans("#' Title\n#' more\nx <- r\"(a\\d)\"", "r")] == ["#' Title\n#' more", "(a\\d)"]
    assert list(prose.code_spans("%%bash\n# a b c d e", "python")) == []
    assert list(prose.code_spans("# x", "cobol")) == []


@pytest.mark.parametrize("text,kind", [("# df = df.drop('a b', axis=1)", "comment"), ("tar -xzf ../input/a.tgz -C /tmp/x", "literal"), ("a_b,c_d,e_f", "literal"), ("<td class='a'><b>%d</b></td>", "literal"), ("# TODO", "comment"), ("", "comment")])
def test_not_running_text(text, kind):
    assert prose.candidate(text, kind) is None


def test_prose_in_cells(spark, monkeypatch):
    monkeypatch.setattr(prose, "fitted", lambda cells: fitted())
    cells = spark.createDataFrame(
        [
            ("a", "n1", "code", [f"# {TEXTS['en']}", "x = 1"], "x"), ("b", "n1", "code", [f'print("{TEXTS["de"]}")'], "x"), ("c", "n1", "code", ["x = 'a b'", None], "x"),
            ("d", "n1", "code", None, "x"), ("e", "n2", "code", [f"# {TEXTS['zh']}"], "x"), ("f", "gone", "code", [f"# {TEXTS['en']}"], "x"), ("g", "n1", "markdown", [TEXTS["en"]], "x"),
        ],
        "_id string, notebook_id string, type string, content array<string>, language string",
    ).selectExpr("*", "cast(null as array<string>) content_no_comment")
    notebooks = spark.sql("select 'n1' _id, 1L notebook_id, 'python' language, 'r' repository, timestamp'2024-01-01' loaded_at union all select 'n2', 2L, 'julia', null, null")
    assert {tuple(r) for r in prose.prose_in_cells(cells, notebooks).collect()} == {("a", "en"), ("b", "de"), ("e", "zh")}
    shares = {(r["notebook_id"], r["lang"]): r["share"] for r in prose.prose_shares(cells.unionAll(cells), notebooks).collect()}
    assert set(shares) == {(1, "en"), (1, "de"), (2, "zh")} and all(0 < x <= 1 for x in shares.values())
    assert prose.prose_in_cells(cells.limit(0), notebooks).count() == 0


def test_bytes_of_a_span_in_two_languages_are_shared(spark, monkeypatch):
    monkeypatch.setattr(prose, "fitted", lambda cells: fitted())
    cells = spark.createDataFrame([("a", "n1", "code", [f"# {TEXTS['en']}", f"# {TEXTS['de']}"], None)], "_id string, notebook_id string, type string, content array<string>, content_no_comment array<string>")
    notebooks = spark.sql("select 'n1' _id, 1L notebook_id, 'python' language, 'r' repository, timestamp'2024-01-01' loaded_at")
    rows = {r["lang"]: r for r in prose.prose_shares(cells, notebooks).collect()}
    assert set(rows) == {"en", "de"} and sum(r["share"] for r in rows.values()) <= 1
    short = ([w for w in fitted_words("en")] * 12) + fitted_words("de")  # a thirteenth of the words, all next to each other
    assert dict(prose.span_languages(fitted(), [" ".join(short)])[0]).keys() == {"en", "de"}


def fitted_words(name):
    return language.line_words(TEXTS[name])[0]


# ---- 5 syntax

GOOD = {
    "python": ["x = 1", "%matplotlib inline\nx", "!ls -l\ndf.head?", "%%bash\nif [", "", "   ", "def f(x):\n    return x"],
    "r": ["x <- c(1, 2)\ny = x[-1]", "f <- function(a, b = 2, ...) {\n  if (a) {\n 1\n } else {\n 2\n }\n}", "x %>% f() %>%\n g()", "l[['a']][y[1]]", "y ~ x + z", "\\(x) x + 1", "if (a) b else c", "`my v` <- 1", "f(a=, b)", "x[,1]"],
    "julia": ["f(x) = x^2 + 1", "x = [1 2; 3 4]", "map(xs) do x\n x + 1\nend", "a ? b : c", "A[:, end]'", "df[!, :x]", "filter!(r -> r.a > 1 && r.b < 2, df)", "try\n f()\ncatch e\n g(e)\nend", "@info \"a $(f(\"x\"))\"", "#= a #= b =# =#\nx .+= 1", "for i in 1:3, j in 1:2\nend"],
}
BAD = {
    "python": ["x = (1", "print 'x'", "<<<<<<< HEAD\nx", "if x:\n"],
    "r": ["import os", "x <- (1", "if (x) y\nelse z", "a < b < c", "'\\d'", "[1, 2]", "a b", "}"],
    "julia": ["def f(x):\n  return 1", "x = 'abc'", "for i in 1:3", "end", "a b", "1 +", "{\n \"a\": 1\n", "=======\nx"],
}


@pytest.mark.parametrize("name", ["python", "r", "julia"])
def test_grammars(name):
    assert [c for c in GOOD[name] if grammars.GRAMMARS[name](c)] == []
    assert [c for c in BAD[name] if not grammars.GRAMMARS[name](c)] == []


def test_deep_and_long_code_does_not_crash():
    for name, grammar in grammars.GRAMMARS.items():
        deep = grammar("(" * 50_000 + "1" + ")" * 50_000)
        assert deep is None or name == "python"  # whose own parser has a limit
        assert grammar("x = 1\n" * 20_000) is None, name


def test_invalid_notebooks(spark):
    cells = spark.createDataFrame(
        [("a", "n1", "code", ["x = (1"]), ("b", "n1", "code", ["x"]), ("c", "n2", "code", ["import os"]), ("d", "n3", "code", ["x <- 1"]), ("e", "n4", "code", None), ("f", "n1", "markdown", ["("]), ("a", "n1", "code", ["x = (1"])],
        "_id string, notebook_id string, type string, content array<string>",
    ).selectExpr("*", "'x' as salt", "'y' as repository")
    notebooks = spark.sql("select * from values ('n1', 1L, 'python'), ('n2', 2L, 'r'), ('n3', 3L, null), ('n4', 4L, 'julia') t(_id, notebook_id, language)").selectExpr("*", "'o/p' as repository", "timestamp'2024-01-01' as loaded_at")
    assert {r[0] for r in syntax.invalid_notebooks(cells, notebooks).collect()} == {1, 2}
    found = {r["cell_pk"]: r["parses_as"] for r in syntax.cell_syntax(cells, notebooks).where("not valid").collect()}
    assert found == {"a": None, "c": "python"}
    accepted = {r["cell_pk"]: sorted(r["accepted"]) for r in syntax.cell_syntax(cells, notebooks).collect()}
    assert accepted == {"a": [], "b": ["julia", "python", "r"], "c": ["julia", "python"], "d": [], "e": []}
    rates = {r["language"]: (r["cells"], r["invalid_cells"], r["foreign_cells"]) for r in syntax.syntax_rates(cells, notebooks).collect()}
    assert rates["python"] == (2, 1, 0) and rates["r"] == (1, 1, 1)


# ---- 6 tokens


def test_tokens_equal_the_public_tokenizer(spark, data):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    public = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    odd = [None, "", " ", "  x  y ", "a\n\n  b\t c", "don't 'll x's", "é😀 漢字 <|endoftext|>", "x" * 5000, "\x1c \x1f a", "\xa0a \u2028 b", "  \n", "ab" * 300 + " 12345678 " * 50]
    docs = spark.createDataFrame(list(enumerate(odd)) + list(enumerate(odd)), "doc_id bigint, text string").unionByName(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    texts = docs.rdd.map(lambda r: (r["doc_id"], r["text"])).collect()
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in tokenize.encode_corpus(docs, VOCABULARY).collect())
    assert got == sorted((i, tuple(public.encode_ordinary(t or ""))) for i, t in texts)


def test_trie_shares_prefixes():
    encoder = tokenize.TrieEncoder(VOCABULARY)
    words = [" interesting", " interested", " interest", "zzqq", " interestingly"]
    encoder.insert(words)
    assert all(encoder.words[w] == encoder.merged(w.encode()) for w in words)


# ---- 7 leaks


@pytest.mark.parametrize("letters", [leaks.INDEX_LETTERS, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, letters):
    monkeypatch.setattr(leaks, "INDEX_LETTERS", letters)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))) for _ in range(20)]
    docs = []
    for i in range(150):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.6:
            p = rng.choice(passages).split()
            n = rng.randint(9, 15)
            s = rng.randint(0, max(0, len(p) - n))
            parts.append(", ".join(p[s : s + n]).upper())
        docs.append((i, " ".join(parts), "extra"))
    docs += [(900, None, ""), (901, "", ""), (902, "ﬁ " * 5, ""), (903, (passages[0] + " ") * 300, ""), docs[0]]
    items = [(i, p) for i, p in enumerate(passages)] + [(90, None), (91, "short one"), (None, passages[1]), (3, passages[4])]  # 3 has two passages
    w = lambda t: re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").lower())
    runs = lambda t: {tuple(w(t)[i : i + 12]) for i in range(len(w(t)) - 11)}
    in_docs = [(d, runs(t)) for d, t, _ in docs]
    want = {(i, d) for i, p in items if i is not None for d, r in in_docs if runs(p) & r}
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string, sig string"), spark.createDataFrame(items, "item_id bigint, passage string")
    assert want and {(r["item_id"], r["doc_id"]) for r in leaks.leaked(d, q).collect()} == want
    assert leaks.leaked(d.limit(0), q).count() == 0 and leaks.leaked(d, q.limit(0)).count() == 0
    assert leaks.leak_report(d, q).count() == len({i for i, _ in want})


def test_least_case_is_signed_in_documents_of_all_sizes():
    rng, least = random.Random(6), [f"p{i}" for i in range(leaks.RUN)]
    missed = total = 0
    for size in (0, 5, 30, 200, 1500) * 40:
        least = [f"p{rng.random()}" for _ in range(leaks.RUN)]
        text = [f"w{rng.random()}" for _ in range(size)]
        at = rng.randint(0, size)
        values = set(leaks.signed([text[:at] + least + text[at:]])[1].tolist())
        shingles = set(leaks.shingle_hashes([least])[1].tolist())
        rate = len(values & shingles) / len(shingles)
        missed, total = missed + (rate == 0), total + rate
    assert missed == 0 and total / 200 > 0.7


# ---- 8 encoding


def garbled_corpus():
    clean = {
        "fr": "Les données sont déjà prêtes, le modèle a été entraîné à l’été et la fenêtre reste fermée. Ça marche très bien, même après.",
        "de": "Für die endgültige Fassung löschen wir alle Zeilen, die größer sind; die Häuser wären schöner. Über Äpfel später.",
        "ru": "Поскольку памяти мало, мы удаляем строки, где нет значения, и сохраняем всё на диск. Потери медленно снижаются.",
        "en": "We couldn’t find any reason – the values don’t look right… “quoted” text isn’t needed for small files.",
    }
    rows = [(i * 10 + j, t) for i in range(120) for j, t in enumerate(clean.values())]
    fr, de, ru, en = clean.values()
    bad = {
        9001: fr.encode().decode("cp1252", "replace").replace("�", "\x9d"), 9002: en.encode().decode("latin-1"), 9003: de.encode("cp1252").decode("mac_roman"),
        9004: ru.encode("koi8_r").decode("cp1251"), 9005: en.encode("mac_roman").decode("cp1252"), 9006: "caf� et d�j�", 9007: fr.encode().decode("latin-1").encode().decode("latin-1"),
    }
    fine = {9101: "plain `Ã©` and ```\nâ€™\n``` quoted", 9102: None, 9103: "", 9104: "20 °C ± 3 €", 9105: fr.upper(), 9106: "x" * 100_000, 9107: unicodedata.normalize("NFD", fr)}
    return rows, bad, fine, clean


def test_garbled_text_is_found_and_restored(spark):
    rows, bad, fine, clean = garbled_corpus()
    docs = spark.createDataFrame(rows + list(bad.items()) + list(fine.items()), "doc_id bigint, text string").selectExpr("*", "'z' as garbled", "1 as n")
    found = {r["doc_id"]: r["restored"] for r in encoding.repaired(docs).where("garbled").collect()}
    assert set(found) == set(bad)
    assert found[9002] == clean["en"] and found[9003] == clean["de"]
    assert encoding.garbled_documents(docs.limit(0)).count() == 0


def test_segments_are_maximal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = rng.choice([-1.0, -0.5, 0.5, 1.0, 2.0], size=12)
        got = encoding.segments(x)
        best = max((x[i:j].sum() for i in range(12) for j in range(i + 1, 13)), default=0)
        if best > 0:
            assert np.isclose(max(x[i:j].sum() for i, j in got), best)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
