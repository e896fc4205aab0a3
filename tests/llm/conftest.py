import random

import pytest

WORDS = {
    "en": "the of and to in that was for with his they this have from word what there said each which their time will about many then them these some her would make like him into has look two more write see number way could people than first water been call who now find long down day did get come made may part".split(),
    "de": "der die und den von das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat daß sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei schön größe".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au bien pouvoir plus dire tout nous me faire mon même autre aussi où deux voir donner très après là été chose ça année".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of three languages with copies, near copies, nulls, empty texts, a long text and an extra column."""
    rng, rows = random.Random(4), []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(20, 90)), lang, f"src{i % 5}"))
    for i in range(240, 260):  # copies, and copies with one word changed
        text = rows[i - 240][1]
        words = text.split()
        words[len(words) // 2] = "changed"
        rows.append((i, text if i % 2 else " ".join(words), rows[i - 240][2], "src0"))
    rows += [(300, None, "en", "src1"), (301, "", None, None), (302, "123 !!! ???", "en", "src1"), (303, "one two three", "en", "src2"), (304, "One  TWO\nthree", "en", "src2"), (305, prose(rng, "en", 9000), "en", "src3")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, source string, score string")
    return df.repartition(5).cache()
