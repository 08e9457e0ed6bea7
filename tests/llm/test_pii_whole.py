import random
import re

from plumbline.llm import pii


def test_hint_passes_over_nothing(spark, make):
    texts = ["password=correcthorse", "x token : abcdefgh", "abcdef" * 6, "AKIA" + "ABCDEFGHIJKLMNOP", "Secret='hunterhunter'"]
    rows = pii.replace(make(texts)).orderBy("doc_id").collect()
    assert [r["n_entities"] for r in rows] == [1] * 5
    assert rows[0]["text"].startswith("password=") and "correcthorse" not in rows[0]["text"] and len(rows[0]["text"]) == len(texts[0])
    assert re.fullmatch("[a-f]{36}", rows[2]["text"]) and rows[2]["text"] != texts[2]


def test_long_secrets_are_replaced_to_their_end(spark, make):
    rng = random.Random(3)
    token = "".join(rng.choice("ghijklmnopqrstuvwxyzGHIJKLMNOP0123456789") for _ in range(400))
    key = "".join(rng.choice("0123456789abcdef") for _ in range(300))
    huge = "".join(rng.choice("0123456789ABCDEF") for _ in range(50_000))
    out = [r["text"] for r in pii.replace(make([f"token={token} end", f"see {key} there", f"see {huge}"])).orderBy("doc_id").collect()]
    new = re.fullmatch("token=([A-Za-z0-9]{400}) end", out[0])[1]
    assert not any(token[i : i + 12] in new for i in range(389)) and new[:32].lower() != new[32:64].lower()
    hexes = re.fullmatch("see ([0-9a-f]{300}) there", out[1])[1]
    assert not any(key[i : i + 16] in hexes for i in range(285)) and len({hexes[i : i + 16] for i in range(0, 288, 16)}) == 18
    assert re.fullmatch("see [0-9A-F]{50000}", out[2]) and huge[-16:] != out[2][-16:]
