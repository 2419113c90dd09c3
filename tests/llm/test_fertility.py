import base64
import random

import regex

from kmerlake.llm.bpe import PATTERN
from kmerlake.llm.common import tokenizer_path
from kmerlake.llm.fertility import base_measures, duplicate_lines, encode, load_ranks, main_script, quality_rules, repeated_words

RANKS = tokenizer_path("byte_bpe_multi_50k.tiktoken")


def brute_repeated(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)})


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(300):
        words = rng.choices([b"a", b"b", b"c"], k=rng.randrange(40))
        assert repeated_words(words) == brute_repeated(words)


def test_base():
    assert base_measures(None) == (0, 0, 0, 0, 0, True)
    assert base_measures("ab c d\n# *\n# *\n \n")[:4] == (6, 9, 4, 1)
    assert duplicate_lines("a\n\n\na\n a\n") == 1
    text = " ".join("one two three four five".split() * 2)
    assert base_measures(text)[4:] == (10, True)


def test_scripts():
    assert [main_script(t) for t in ("abc", "123", "привет a", "漢字漢字 ab", "ไทย", "")] == ["Latin", "other", "Cyrillic", "Han", "other", "other"]


def test_rows(odd_docs):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality_rules(odd_docs, RANKS).collect()}
    assert rows[(1, 17)]["kept"] and not rows[(3, 0)]["kept"] and not rows[(5, 1)]["kept"] and rows[(7, 40000)]["n_tokens"] > 40000
    assert all(r["base_failed"] for k, r in rows.items() if k[1] < 10)
    assert not any(r["kept"] for r in rows.values() if r["base_failed"])
    assert quality_rules(odd_docs.limit(0), RANKS).count() == 0


def test_bands_reject(spark):
    clean = "The weather was mild and the travellers walked along the river until the evening came."
    junk = " ".join("zqxj" + chr(0x0E00 + i) * 3 for i in range(1, 40))
    docs = spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")
    tight = {"Latin": (2.0, 9.0, 0.1, 0.4), "other": (1.5, 9.0, 0.1, 0.2)}
    assert [r["kept"] for r in quality_rules(docs, RANKS, bands=tight).orderBy("doc_id").collect()] == [True, False]


CLEAN = {
    "Latin": "The weather was mild and the travellers walked along the river until the evening came.",
    "Cyrillic": "Сегодня была очень хорошая погода, мы долго гуляли вдоль реки и только вечером вернулись домой",
    "Greek": "Σήμερα ο καιρός ήταν πολύ καλός και περπατήσαμε δίπλα στο ποτάμι μέχρι το βράδυ",
    "Arabic": "كان الطقس اليوم جميلا جدا ومشينا على طول النهر حتى المساء ثم عدنا إلى البيت",
    "Han": "今天 天气 非常 好 我们 沿着 河边 散步 一直 走到 傍晚 才 回家 吃 晚饭",
    "Thai": "สวัสดี ตอนเช้า วันนี้ อากาศ ดี มาก เรา เดินเล่น ริม แม่น้ำ และ กลับบ้าน ตอนเย็น",
    "Hangul": "오늘은 날씨가 매우 좋아서 우리는 강을 따라 산책을 하고 저녁에 집으로 돌아왔습니다",
    "Devanagari": "आज मौसम बहुत अच्छा था और हम नदी के किनारे टहलते हुए शाम को घर लौट आए",
    "Hebrew": "היום מזג האוויר היה נעים מאוד והלכנו לאורך הנהר עד שהגיע הערב וחזרנו הביתה",
    "Hiragana": "きょうは とても いい てんき だった ので わたしたち は かわ の そば を あるいて ゆうがた いえ に かえりました",
}
LETTERS = {
    "Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": range(0x430, 0x450), "Greek": range(0x3B1, 0x3CA), "Arabic": range(0x627, 0x64B),
    "Han": range(0x4E00, 0x9FA5), "Thai": range(0xE01, 0xE2F), "Hangul": range(0xAC00, 0xD7A3), "Devanagari": range(0x904, 0x939),
    "Hebrew": range(0x5D0, 0x5EB), "Hiragana": range(0x3041, 0x3097)}


def test_production_bands(spark):
    """Gibberish of each script is rejected by the bands that the query uses, clean text is kept."""
    rng = random.Random(7)
    rows = [(script, True, text) for script, text in CLEAN.items()]
    for script, letters in LETTERS.items():
        letters = [c if isinstance(c, str) else chr(c) for c in letters]
        rows += [(script, False, " ".join("".join(rng.choices(letters, k=rng.randrange(3, 10))) for _ in range(60))) for _ in range(5)]
    rows += [("Latin", False, " ".join(base64.b64encode(rng.randbytes(12)).decode() for _ in range(40))), ("Latin", False, " ".join(rng.randbytes(8).hex() for _ in range(40)))]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, want string, clean boolean, text string")
    got = quality_rules(docs, RANKS).collect()
    assert not any(r["base_failed"] for r in got)
    assert [(r["want"], r["clean"], r["text"][:20]) for r in got if r["script"] != r["want"] or r["kept"] != r["clean"]] == []


def test_given_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    rows = quality_rules(docs, RANKS, keep=["doc_id"]).where("not base_failed").join(labels, "doc_id", "left").collect()
    rejected = [r for r in rows if not r["kept"]]
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["quality"] == 0 for r in rejected) >= 10
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


def test_long_runs_of_blanks():
    model, _ = load_ranks(RANKS, PATTERN)
    cut = regex.compile(PATTERN)
    for text in ("a" + " " * 30_000 + "b c", "\n" * 25_000 + " x\t", " " * 22_000, "one two", "é" + "\n " * 15_000 + "z"):
        assert encode(model, cut, text) == model.encode_ordinary(text)
    ids = encode(model, cut, "start" + " " * 1_000_000 + "end")  # the encoder alone runs out of stack here
    assert model.decode(ids) == "start" + " " * 1_000_000 + "end"
