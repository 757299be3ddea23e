"""Review text, attributes and vectors on hand-written cases."""

from pyspark.sql import functions as F

from listingscope.functions import text as T


def test_text_length_and_placeholder(table):  # T12
    rows = table("p int, text string", (1, " 12345 "), (1, " 123456\n"), (2, "Sem texto."), (2, None), (3, " \n"))
    assert [r.text for r in T.usable_reviews(rows, "p").orderBy("text").collect()] == ["12345", "123456", "Sem texto."]
    assert [r.text for r in T.usable_reviews(rows, "p", min_chars=5).orderBy("text").collect()] == ["123456", "Sem texto."]
    assert T.usable_reviews(rows, "p", placeholders=("Sem texto.",)).count() == 2


def test_words_are_counted_without_overlap(table):
    df = table("t string", ("Falso! falsofalso aaa não é HP",))
    assert df.select(T.word_hits(F.col("t"), ("falso", "aa", "não é hp", "."))).first()[0] == 3 + 1 + 1


def test_review_features_and_defaults(table):
    reviews = table("p string, review_no int, text string", ("a", 1, "produto falso e ruim"), ("a", 2, "vazou e quebrou"), ("b", 1, "ok"))
    lexicon = table("word string, valence double", ("ruim", -3.0), ("ok", 2.0))
    r, short = T.review_features(reviews, "p", lexicon).orderBy("p").collect()
    assert (r.p, r.n_texts, r.fraud_hits, r.performance_hits) == ("a", 2, 1, 3) and (short.n_texts, short.sentiment) == (1, 2 / 19**0.5)
    assert T.review_features(reviews, "p", lexicon, min_chars=5).count() == 1
    assert abs(r.sentiment - (-3 / 24**0.5) / 2) < 1e-12


def attributes(table, *titles):
    rows = table("n int, t string", *enumerate(titles)).select("n", T.attributes(F.col("t")).alias("a")).orderBy("n").collect()
    return [(r.a.cartridge_type, r.a.colours.preto, r.a.colours.colorido, r.a.quantity, r.a.used) for r in rows]


def test_attribute_examples(table):
    found = attributes(
        table, "2 cartuchos pretos HP 664", "Kit 667 preto + colorido", "Cartucho HP 664XL colorido", "3x 662 preto", "Kit CZ103AB e CZ104AB",
        "Pack com 4 cartucho 662 preto", "3 unidades preto 62", "Cartucho vazio 664", "Impressora", "664 xl e 664 preto", None)
    assert found == [
        ("664", 1, 0, 2, 0), ("667", 1, 1, 2, 0), ("664xl", 0, 1, 1, 0), ("662", 1, 0, 3, 0), ("662", 1, 1, 2, 0),
        ("662", 1, 0, 4, 0), ("62", 1, 0, 3, 0), ("664", 1, 0, 1, 1), ("desconhecido", 1, 0, 1, 0), ("664xl", 1, 0, 1, 0), ("desconhecido", 1, 0, 1, 0)]


def test_vectors(table):  # T13
    df = table("t string", ("[1,2,3]",), ("[1,2]",), ("no",), (None,))
    assert [r[0] for r in df.select(T.parse_vector(F.col("t"), 3)).collect()] == [[1.0, 2.0, 3.0], [0.0] * 3, [0.0] * 3, None]


def test_image_names(table):
    df = table("u string", ("http://x/A.WEBP",), ("http://x/b?png",), ("x",))
    assert [r[0] for r in df.select(T.image_extension(F.col("u"))).collect()] == ["webp", "png", "jpg"]
    assert df.select(T.file_stem(F.lit("dir/MLB12.jpg"))).first()[0] == "MLB12"


def test_embedding_pieces_hold_the_whole_text(table):  # G8
    df = table("d int, text string", (1, " " + "ab" * 9 + "c "), (2, ""), (3, None), (4, "x" * 10))
    got = [tuple(r) for r in T.embedding_pieces(df, size=5).orderBy("d", "piece_no").collect()]
    assert got == [(1, 0, "ababa"), (1, 1, "babab"), (1, 2, "ababa"), (1, 3, "babc"), (2, 0, ""), (4, 0, "xxxxx"), (4, 1, "xxxxx")]
