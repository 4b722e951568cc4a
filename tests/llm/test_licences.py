"""Files that hold many notices."""

from foundling.llm import licences


def test_every_notice_of_a_file_is_found(rows_of_text):
    every = "\n\n".join(wording + "." for _, wording, _ in licences.NOTICES)
    passing = "Mozilla forms a domain; redistribution of binary source, unencumbered, affero, lesser attribution, creative commons. " * 20
    fee = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    texts = [every, passing + fee, passing] + ["river stone"] * 5
    out = {r.doc_id: r for r in licences.scan(rows_of_text(texts)).select("row.doc_id", "labels", "notices").collect()}
    assert out[0].labels == ",".join(sorted({label for label, _, _ in licences.NOTICES}))
    words, starts = licences.tokens(every), []
    for label, wording, _ in licences.NOTICES:
        own = licences.tokens(wording)
        starts += [(label, i) for i in range(len(words)) if words[i:i + len(own)] == own]
    assert set(starts) <= {(n.label, n.first_word) for n in out[0].notices}
    assert out[1].labels == "isc" and out[2].labels == ""
