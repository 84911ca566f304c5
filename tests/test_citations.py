from lectern.operators import citations


def test_names_and_numbers(spark):
    texts = ["see 2 Cor. 4:17,18 now", "Cor. 4:17", "First Thessalonians chapter 5 verse 17", "John 3:16 and 1 John 4:8", "Dan. 2:44; 7:22,27 x", "Volume 6 chapter 2 verse 1", "James 4.3", "Psalm 66, verses 8 to 9", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokens = citations.book_tokens(spark)
    got = sorted((r.id, r.begin, r.surface, r.book, r.numbers) for r in citations.name_citations(citations.find_citations(df, tokens), tokens).collect())
    assert got == [
        (0, 4, "2 Cor. 4:17,18", "2 Corinthians", "4:17,18"),
        (1, 0, "Cor. 4:17", None, "4:17"),
        (2, 0, "First Thessalonians chapter 5 verse 17", "1 Thessalonians", "5:17"),
        (3, 0, "John 3:16", "John", "3:16"),
        (3, 14, "1 John 4:8", "1 John", "4:8"),
        (4, 0, "Dan. 2:44; 7:22,27", "Daniel", "2:44;7:22,27"),
        (6, 0, "James 4.3", "James", "4:3"),
        (7, 0, "Psalm 66, verses 8 to 9", "Psalms", "66:8-9"),
    ]


def test_restore(spark):
    rows = [("@1@ then ＠ 0 ＠.", ["A 1:1", "B 2:2"], "B 2:2 then A 1:1."), ("@7@ x ", ["A 1:1"], "@7@ x A 1:1"), ("", [], ""), ("@99999999999@", ["A"], "@99999999999@ A")]
    df = spark.createDataFrame(rows, "t string, refs array<string>, want string")
    out = df.select(citations.restore_citations(df.t, df.refs).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]
