import random

from glimmerframe.llm import cues, leaks

PASSAGE = "Why do you think the old Captain repaired our muddy bicycle behind every lonely farmhouse? There is a piano."
WORDS = PASSAGE.split()


def found(spark, texts, passages, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as item_id")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    return sorted(tuple(r) for r in leaks.find_leaks(docs, items, **more).collect())


def test_noise_that_does_not_count(spark):
    cued = "1\n00:00:01,000 --> 00:00:02,000\n<i>WHY do you think the old\n\n2\r\n00:00:02,000 --> 00:00:04,000\r\nCaptain repaired [door creaks] our muddy\n\n3\n00:00:05,000 --> 00:00:06,000\n{\\an8}bicycle behind every lonely!</i>\n"
    misread = "xx " + " ".join(WORDS[:14]).replace("m", "rn").replace("h", "li").replace("o", "0") + " yy"
    assert found(spark, [cued, misread, " ".join(WORDS[:11]) + " other " + " ".join(WORDS[12:]), "", None, PASSAGE, PASSAGE], [PASSAGE, "No. No, no.", "", None]) == [(0, 0), (1, 0), (5, 0), (6, 0)]


def test_eleven_words_are_no_leak_and_twelve_are(spark):
    assert found(spark, [" ".join(WORDS[2:13]), " ".join(WORDS[2:14])], [PASSAGE]) == [(1, 0)]


def test_wrong_encoding(spark):
    passage = "Dónde está nuestro médico, señora Morva? Él no quería ningún avión azul así mañana también"
    texts = [passage.encode().decode("latin-1"), passage.encode().decode("cp1252", "replace"), passage.encode("latin-1").decode("utf-8", "replace")]
    assert found(spark, texts, [passage]) == [(0, 0), (1, 0), (2, 0)]


def test_blocks_give_the_same_as_one_block_and_as_brute_force(spark):
    r = random.Random(5)
    vocabulary = [a + b for a in "ka lo mi nu pe ra so tu".split() for b in "dan fel gor hab jin kol".split()]
    passages = [" ".join(r.choices(vocabulary, k=r.randint(3, 40))) for _ in range(30)]
    texts = []
    for _ in range(60):
        words = r.choices(vocabulary, k=40)
        p = r.choice(passages).split()
        a, n = r.randrange(len(p)), r.randint(8, 20)
        texts.append(" ".join(words[:20] + p[a : a + n] + words[20:]))
    want = []
    for i, t in enumerate(texts):
        bones = [cues.skeleton(w) for w in t.split()]
        for j, p in enumerate(passages):
            own = [cues.skeleton(w) for w in p.split()]
            if any(all(cues.same(bones[x + k], own[y + k]) for k in range(12)) for x in range(len(bones) - 11) for y in range(len(own) - 11)):
                want.append((i, j))
    assert want and found(spark, texts, passages) == want == found(spark, texts, passages, block_words=50)


def test_long_passages_are_cut_by_the_words_that_are_compared(spark):
    passage = "\n".join(f"[x] {a}{b}" for a in "ka lo mi nu pe ra so tu".split() for b in "dan fel gor hab jin kol".split())  # no blank between words
    words = [w for w in passage.split() if w != "[x]"]
    codes = leaks.Codes()
    parts = list(leaks.segments(passage, codes, 12, 20))
    assert all(12 <= len(p) <= 20 for p in parts) and {tuple(words[i : i + 12]) for i in range(37)} == {tuple(p[i : i + 12]) for p in parts for i in range(len(p) - 11)}
    assert list(leaks.segments("one\t" * 400_001, codes, 12, 400_000))[0] == ["one"] * 400_000
    assert found(spark, [" ".join(words[7:19]), " ".join(words[7:18])], [passage, " ".join(words[30:])], block_words=24) == [(0, 0)]


def test_only_long_words_may_differ_by_a_character():
    for a, b in (("mother", "another"), ("friends", "friend"), ("house", "mouse"), ("nothing", "noting")):
        assert not cues.same(cues.skeleton(a), cues.skeleton(b))
    for a, b in (("farmhouse", "farrnhcuse"), ("żDónde", "¿Dónde"), ("ni�o", "niño")):
        assert cues.same(cues.skeleton(a), cues.skeleton(b))


def test_empty_tables_and_long_text(spark):
    assert found(spark, ["filler " * 200_000 + PASSAGE], [PASSAGE]) == [(0, 0)]
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, passage string")
    assert leaks.find_leaks(docs, items).collect() == []
