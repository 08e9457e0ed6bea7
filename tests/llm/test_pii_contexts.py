"""Texts made of plain stretches and marked entities, so that what has to change, and what has to stay, is known."""

import re

from plumbline.llm import pii

#: ⟦kind:value⟧ marks what has to be replaced, in the same form; everything else has to stay as it is.
TEXTS = [
    '{"password": "⟦s:hunter2secret⟧", "api_key": "⟦s:abcDEF123456⟧", "user": "x"}',
    "password=⟦s:P@ssw0rd2024!⟧ and password=⟦s:Tr0ub4dor&Zebra⟧ end",
    "db:\n  password: ⟦s:c0rrect/horse+battery==⟧\n  host: db.internal\n",
    "export TOKEN=⟦s:zq~9#kk|88x⟧\nexport SECRET='⟦s:päss-wört-ключ99⟧'\nPORT=8080",
    "'token': '⟦s:hunter2secret⟧'; tokens: 5, secretary: someone",
    "⟦n:Mr Kwame Mensah⟧ arrived. Author: ⟦n:Kwame Mensah⟧.",
    "Later ⟦n:Mrs Zola Quark⟧ left. My name is ⟦n:Zola Quark⟧, ⟦l:Quark⟧.",
    "The Committee said no. New York said yes. I am Very Happy today. On Monday Big Blue said so.",
    "The North Sea and Great Plains wrote history. This Year said nothing. I'm So Glad.",
    "I am ⟦n:Tunde Bakare⟧, she replied.\n⟦n:Amara Obi⟧ said no; ⟦n:Lars Holm⟧ and ⟦n:Mei Tan⟧ wrote back.",
    "Call ⟦p:020 7946 0958⟧ or ⟦p:+44 20 7946 0958⟧ at 12:34:56, ratio 1:2, room 020 79.",
    "from ⟦6:2001:0db8:85a3:0000:0000:8a2e:0370:7334⟧ to ⟦6:fe80::1ff:fe23:4567:890a⟧ and std::vector, a::b::c::d zz::yy",
    "again ⟦6:FE80::1FF:FE23:4567:890A⟧ and 192.0.2 only",
    "Ñandú 12 wrote 3 plain words; Über Alles",
]


def test_what_is_marked_changes_and_nothing_else(spark, make):
    plain = [re.sub(r"⟦\w:(.*?)⟧", r"\1", t, flags=re.S) for t in TEXTS]
    rows = pii.replace(make(plain)).orderBy("doc_id").collect()
    new: dict[tuple[str, str], set[str]] = {}
    for text, row in zip(TEXTS, rows, strict=True):
        pieces = re.split(r"⟦(\w):(.*?)⟧", text, flags=re.S)
        pattern = "".join(re.escape(p) if i % 3 == 0 else "" if i % 3 == 1 else r"([^\s\"',;]+)" if pieces[i - 1] == "s" else r"([\w.+:-]+(?: [\w.+:-]+)*?)" for i, p in enumerate(pieces))
        found = re.fullmatch(pattern, row["text"], flags=re.S)
        assert found, (text, row["text"])
        for kind, old, now in zip(pieces[1::3], pieces[2::3], found.groups(), strict=True):
            assert old != now, (text, row["text"])
            if kind == "s":
                # Signs stay in place, letters and digits change as a whole; nothing of four of them is left.
                assert [c.isalnum() for c in old] == [c.isalnum() for c in now]
                assert not any(old[i : i + 4].isalnum() and old[i : i + 4] in now for i in range(len(old) - 3))
            if kind == "6":
                assert len(old) == len(now) and re.sub("[0-9A-Fa-f]", "x", old) == re.sub("[0-9A-Fa-f]", "x", now)
            new.setdefault((kind, old.lower()), set()).add(now.lower())
    assert all(len(v) == 1 for v in new.values())  # the same entity, the same surrogate, over texts and contexts
    first = {old: next(iter(now)) for (kind, old), now in new.items() if kind == "n"}
    assert first["mr kwame mensah"] == "mr " + first["kwame mensah"] and first["mrs zola quark"] == "mrs " + first["zola quark"]
    male, female = ({n.lower() for k in pii.GIVEN if k[1] == g for n in pii.GIVEN[k].split()} for g in "mf")
    assert first["kwame mensah"].split()[0].split("-")[0] in male and first["zola quark"].split()[0].split("-")[0] in female
    assert first["zola quark"].split()[1] == next(iter(new["l", "quark"]))
    assert len({next(iter(v)) for v in new.values()}) == len(new)  # different entities, different surrogates
    assert [r["n_entities"] for r in rows][7:9] == [0, 0]
