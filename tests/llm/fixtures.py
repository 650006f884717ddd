"""Small tables with every oddity, and helpers."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, row int, size string, _id int, rep int, keep_id int"

LONG = " ".join(f"word{i % 997} tale{i % 31}" for i in range(60_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest where nobody ever finds it again".split()


def odd_rows():
    texts = [
        None, "", "   \n\t ", "one", "two words", "Three Words here", "THREE words HERE", "three words here", LONG, LONG.upper(),
        " ".join(BASE), " ".join(BASE), " ".join(BASE[:-1] + ["once"]), "a b c d e f g h " * 30, "tab\tand nbsp em \x1c file", "ÄÖÜ straße Ünï ÀB", "line\nline\nline\n\n x\nline",
        "Mr. John Smith met Frau Erika Mustermann, mail a.b@mail7.example.com or a.b@mail7.example.com", "😀 emoji 😀 #tag $$ | <x>",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None, "b", "c"][i % 4], None if t is None else len(t), 1, 2, "x", 3, 4, 5) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, "three words here", None, None, None, 1, 2, "x", 3, 4, 5))
    return rows


def odd_docs(spark, parts=3):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(parts)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
