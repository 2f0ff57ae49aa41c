"""What the tagger's spans must have, on writings that its own variants don't make."""

from microtide.llm import pii


def test_plausible_writings():
    good = {
        0: ["ann at mail dot example dot org", "ann(at)example.org", "a.b [AT] example [dot] com", "ann @ example . org", "joe_x AT host DOT net"],
        1: ["10[.]0[.]0[.]1", "10 . 0 . 0 . 255", "10,0,0,1", "10-20-30-40", "1 dot 2 dot 3 dot 4"],
        2: ["4111_1111_1111_1111", "4111.1111/1111 1111", "5500-0000-0000-0004"],
        3: ["(030) 1234-5678", "0049 30 1234567", "555.123.4567", "tel 12 34 56 78 90"],
    }
    bad = {
        0: ["### ", '"', "look at this", "meet at 10.30", "@", "a@b", "at example dot"],
        1: ["2.0", "Version 2.0", "1.2.3", "1.2.3.4.5", "300[.]1[.]1[.]1"],
        2: ["1234 5678 9012 3456", "4111", "4111 1111 1111 1112"],
        3: ["1234567890123456", "12345678", "###", ""],
    }
    for kind, spans in good.items():
        assert all(pii.plausible(kind, s) for s in spans), kind
    for kind, spans in bad.items():
        assert not any(pii.plausible(kind, s) for s in spans), (kind, [s for s in spans if pii.plausible(kind, s)])


def test_all_variants_are_plausible():
    for kind, span in enumerate(["ann.lee@mail.example.org", "10.20.30.255", "4111 1111 1111 1111", "+49 30 12345678"]):
        assert all(pii.plausible(kind, v) for v in pii.variants(kind, span))
