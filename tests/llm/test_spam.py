import random

import oracle
from tidemark.llm import queries, spam

PROSE = "The courier left the parcel at the gate, and my neighbour kept it until Friday. I've had this kettle for two years and it still works. Please note that the office is closed on Monday. "


def made(rnd):
    words = ["kettle", "best", "cheap", "shop", "offer", "deal"]
    product = lambda: rnd.choice(["Desk Lamp", "Kettle", "Yoga Mat", "Hose"]) + " " + rnd.choice(["Zola", "Mira", "Tove", "Kuri", "Pano"])
    url = lambda: f"https://{rnd.choice('abcdef') * 6}-shop.example/{rnd.randrange(9999)}/{rnd.choice('xyz') * 5}.html"
    spammy = [
        " ".join(rnd.choice(words) for _ in range(120)),
        " | ".join(product() for _ in range(50)),
        "\n".join(url() for _ in range(20)),
        " ".join(f'<a href="/{rnd.randrange(999)}">cheap kettle</a>' for _ in range(25)),
        "\n".join(f"- [best lamp](//x{rnd.randrange(99)}-blog.invalid/a)" for _ in range(25)),
        " ".join("#cheap" + product().replace(" ", "") for _ in range(50)),
        PROSE[:80] + "\n" + " ".join(rnd.choice(words) for _ in range(120)),
        " ".join(f"Zola kettle is the kettle for kettle fans. Get kettle {rnd.choice(words)}, kettle kit, kettle set." for _ in range(12)),
    ]
    plain = [
        PROSE * 4,
        PROSE * 2 + " ".join(url() for _ in range(2)),
        PROSE * 2 + "kettle lamp deal offer shop",
        "\n".join(f"{rnd.randrange(1, 40)} x {product()} - AB{rnd.randrange(99)}" for _ in range(25)),
        "\n".join(f"{k}: {rnd.randrange(999)} mivo" for k in ("Colour", "Weight", "Height", "Batch", "Origin", "Width") * 4),
        "\n".join(f"2026-01-01T00:00:{i:02d}Z INFO consumer[{i}] mivo offset={rnd.randrange(9999)}" for i in range(20)),
        "sku | qty | min\n" + "\n".join(f"AB-{rnd.randrange(999)} | {rnd.randrange(99)} | {rnd.randrange(99)}" for _ in range(30)),
        '{"order": 1, "lines": [' + ", ".join(f'{{"item": "desk lamp", "qty": {i}}}' for i in range(12)) + "]}",
        "\n".join(f"{i}. Open the box and put the lamp on the desk." for i in range(1, 15)),
        "OK OK OK",
        "½AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA仓库没有货了x=+1;y--;/*z*/999999999999999999999🇧🇷👩‍💻" * 3,
        "",
        None,
        " \n\t ",
    ]
    return spammy, plain


def run(spark, texts, lang="en"):
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, key string, row long")
    return {r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text", "lang").collect()}


def test_kinds(spark):
    rnd = random.Random(4)
    spammy, plain = made(rnd)
    texts = [*spammy, *plain, *[PROSE * (1 + i % 5) for i in range(60)]]
    for lang in ("en", None):
        assert run(spark, texts, lang) == set(range(len(spammy)))


def test_empty_and_repeated_ids(spark):
    assert run(spark, []) == set()
    text = made(random.Random(1))[0][0]
    df = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (None, text, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text", "lang").orderBy("doc_id").collect()] == [None, 1, 1]


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    long_spam = " ".join(rnd.choice(["kettle", "best", "cheap"]) for _ in range(60_000))
    assert run(spark, [long_spam, PROSE * 1000, *[PROSE] * 30]) == {0}


def test_a_brand_named_like_a_function_word(spark):
    rnd = random.Random(3)
    text = ". ".join(" ".join(rnd.choice(["una", "una", "kettle", "sale", "buy"]) for _ in range(6)) for _ in range(25))
    assert run(spark, [text, *[PROSE * 3] * 10]) == {0}


def test_half_a_page_is_no_case(spark):
    rnd = random.Random(3)
    stuffed = " ".join(rnd.choice(["kettle", "best", "cheap"]) for _ in range(120))
    assert run(spark, [stuffed + "\n" + PROSE * 5, *[PROSE * 3] * 30]) == set()


def test_query(spark):
    assert 0 < queries.p10_found(spark, f"{oracle.DATA}/sf0.001").count() < 40


def test_long_pages_with_prose_at_one_end_or_within(spark):
    rnd = random.Random(5)

    def pages(size):
        words = " ".join(rnd.choice(["kettle", "best", "cheap"]) for _ in range(2000))[:size]
        links = "\n".join(f"https://{rnd.choice('abc') * 6}-shop.example/{rnd.randrange(9999)}/{rnd.choice('xyz') * 5}.html" for _ in range(300))[:size]
        return words, links

    texts = []
    for size, share in ((2100, 0.25), (4000, 0.15), (6000, 0.1), (6000, 0.25)):
        prose = (PROSE * 20)[: int(size * share)]
        for page in pages(size - len(prose)):
            texts += [prose + "\n" + page, page + "\n" + prose, page[: size // 3] + "\n" + prose + "\n" + page[size // 3 :]]
    half = [(PROSE * 20)[:2000] + "\n" + page for page in pages(2000)]
    found = run(spark, [*texts, *half, *[PROSE * (1 + i % 20) for i in range(200)]])
    assert found == set(range(len(texts)))


#: Ordinary prose in languages that the corpus has too few texts of to learn from.
FOREIGN = {
    "tr": "Sabah erkenden pazara gittim ve taze ekmek aldım. Komşumuz bahçedeki ağaçları buduyordu. Çocuklar okuldan dönünce birlikte yemek yedik. Akşam hava serinledi, pencereleri kapattık. Yarın annem şehirden gelecek ve hafta sonu bizde kalacak. Babam eski radyoyu onarmaya çalışıyor. ",
    "fi": "Aamulla satoi vettä, mutta iltapäivällä aurinko paistoi järven yllä. Kävimme kaupassa ostamassa leipää ja juustoa. Naapurin koira haukkui pitkään portin vieressä. Illalla luimme kirjoja takkatulen ääressä. Huomenna matkustamme junalla pohjoiseen tapaamaan ystäviä. ",
    "id": "Pagi tadi saya pergi ke pasar membeli sayur dan ikan segar. Tetangga sebelah sedang memperbaiki atap rumahnya. Anak anak bermain layang layang di lapangan. Sore hari hujan turun cukup deras sekali. Besok kami akan berkunjung ke rumah nenek di desa. ",
    "ru": "Утром мы пошли на рынок и купили свежий хлеб. Сосед чинил старую крышу своего дома. Дети играли во дворе до самого вечера. Потом начался сильный дождь, и все вернулись домой. Завтра приедет бабушка и привезёт яблоки. ",
    "el": "Το πρωί πήγαμε στην αγορά και αγοράσαμε φρέσκο ψωμί. Ο γείτονας επισκεύαζε τη στέγη του σπιτιού. Τα παιδιά έπαιζαν στην αυλή μέχρι το βράδυ. Αύριο θα έρθει η γιαγιά μας από το χωριό. ",
}


def test_prose_of_languages_without_texts_to_learn_from(spark):
    rnd = random.Random(8)
    for times in (1, 3):
        texts = [t * times for t in FOREIGN.values()]
        stuffed = " ".join(rnd.choice(["чайник", "купить", "дёшево", "лампа", "скидка", "магазин"]) for _ in range(150))
        tags = " | ".join(rnd.choice(["Чайник", "Лампа", "Коврик"]) + " " + rnd.choice(["Зола", "Мира", "Тове", "Кури", "Пано"]) for _ in range(60))
        assert run(spark, [*texts, stuffed, tags, *[PROSE * (1 + i % 8) for i in range(120)]]) == {len(texts), len(texts) + 1}


def test_function_words_are_learned(spark):
    prose = FOREIGN["ru"].split(". ")
    rnd = random.Random(2)
    rows = [("ru", ". ".join(rnd.sample(prose, 4)) + " и на" ) for _ in range(60)] + [("en", PROSE)] * 60 + [("xx", "the kettle and the lamp")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    found = {r.word for r in spam.learn_function_words(df).collect()}
    assert {"и", "на", "the", "i've"} & found >= {"и", "на"} and "kettle" not in found
    assert spam.learn_function_words(df.limit(0)).collect() == []


def test_mixed_scripts_and_symbols_are_odd():
    words = frozenset()
    assert spam._unit_kind("кот x漢字 κόσμος ab كتاب", "кот x漢字 κόσμος ab كتاب", ["кот", "x漢字", "κόσμος", "ab", "كتاب"], 0, set(), words) == "odd"
    assert spam._unit_kind("кот дом лес", "кот дом лес", ["кот", "дом", "лес"], 0, set(), words) == "tags"
