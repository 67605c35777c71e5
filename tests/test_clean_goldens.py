import pytest
from pyspark.sql import functions as F

from precis.functions import text as T


CLEAN_CASES = [
    ("JAKARTA, liputan6.com -- Presiden Joko Widodo tiba di Bandung. Ia (Jokowi) naik kereta cepat.",
     ("- ",), False, "presiden joko widodo tiba di bandung. ia naik kereta cepat"),
    ("Jakarta – Harga beras naik 3,5 persen. Baca juga: Beras\nbaca juga: harga telur\n• poin satu\nHarga telur turun Rp 1.500 per kg.",
     ("- ",), False, "harga telur turun rp 1500 per kg"),
    ("Harga beras naik tajam.Harga telur turun.", ("- ",), False, "harga beras naik telur turun"),
    ("Café … tutup. Menunggu kabar... besok pagi sekali.", ("- ",), False, " menunggu besok pagi sekali"),
    ("kota: Warga antre, beli minyak goreng. Ya.", ("- ", ": "), True, "warga antre, beli minyak goreng"),
    ("kota: Warga antre, beli minyak goreng. Ya.", ("- ",), True, "kota warga antre, beli minyak goreng"),
    ("A | kolom satu | kolom dua | teks penutup panjang sekali.", (), False, "a kolom dua teks penutup panjang sekali"),
    ("nama_pengguna aktif sekali. __ a _ b _ c __.", (), False, "namapengguna aktif sekali.  a  b  c "),
    ("Pendek. Juga.", ("- ",), False, ""),
]


def test_clean_goldens(spark):
    rows = [(i, c[0]) for i, c in enumerate(CLEAN_CASES)]
    df = spark.createDataFrame(rows, "i int, t string")
    exprs = [T.clean_text(F.col("t"), d, k).alias(f"c{i}") for i, (_, d, k, _) in enumerate(CLEAN_CASES)]
    got = {r["i"]: r for r in df.select("i", *exprs).collect()}
    for i, (_, _, _, want) in enumerate(CLEAN_CASES):
        assert got[i][f"c{i}"] == want, (i, got[i][f"c{i}"], want)


def test_digit_dots(spark):
    df = spark.createDataFrame([("1..2 3...4 .5 6. x",)], "t string")
    assert df.select(T.remove_digit_dots("t")).first()[0] == "12 3.4 5 6 x"


@pytest.mark.parametrize("text,words,dots,ws2,sp2", [
    ("", 0, 1, "", ""),
    (" a b c", 3, 1, "a b", " a"),
    ("a  b c", 3, 1, "a b", "a "),
    ("a. b. c", 3, 3, "a. b.", "a. b."),
])
def test_counts_truncation(spark, text, words, dots, ws2, sp2):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(T.word_count("t").alias("w"), T.dot_piece_count("t").alias("d"),
                  F.array_join(F.slice(F.regexp_extract_all("t", F.lit("[^ ]+"), 0), 1, 2), " ").alias("ws"),
                  T.truncate_words("t", 2, "space").alias("sp"),
                  T.truncate_words("t", 2, "ws").alias("wsa")).first()
    assert (r.w, r.d, r.ws, r.sp) == (words, dots, ws2, sp2)
    # D-TRUNCa only truncates when there are at least n words
    assert r.wsa == (ws2 if words >= 2 else text)


def test_sentences(spark):
    df = spark.createDataFrame([("Pegasus is mythical . It is pure white . it names the model .",), ("",), ("  ",)], "t string")
    got = [r[0] for r in df.select(T.split_sentences("t")).collect()]
    assert got[0] == ["Pegasus is mythical .", "It is pure white .", "it names the model ."]
    assert got[1] == [] and got[2] == []
