"""The model fitted on the notes, on sentences of another hand: recall and precision by kind."""

from collections import Counter

import pytest

from tests.conftest import DATA
from weftline.llm import pii, queries

#: Sentence and its items, each as it begins in the text.
SENTENCES = [
    ("Her daughter Anneliese Vandermeer will drive him home tomorrow.", {("name", "Anneliese")}),
    ("Dr. Okonkwo-Baptiste signed the paperwork this morning.", {("name", "Okonkwo")}),
    ("Spoke with Zbigniew Kowalczyk about the pickup window.", {("name", "Zbigniew")}),
    ("Mr. Thibodeaux prefers the earlier slot.", {("name", "Thibodeaux")}),
    ("Please ask for Priya Raghunathan when you get there.", {("name", "Priya")}),
    ("His wife Guadalupe is waiting in the lobby.", {("name", "Guadalupe")}),
    ("Case discussed with nurse Fitzwilliam, who agreed with the plan.", {("name", "Fitzwilliam")}),
    ("Emergency contact: Siobhan O'Halloran, sister of the patient.", {("name", "Siobhan")}),
    ("Mrs. Nakamura called twice to cancel.", {("name", "Nakamura")}),
    ("Consent by his son Emeka Adeyemi was given verbally.", {("name", "Emeka")}),
    ("The ride was booked by Ingrid Sorensen last night.", {("name", "Ingrid")}),
    ("Prof. Balakrishnan reviewed the chart.", {("name", "Balakrishnan")}),
    ("Patient moved in with her brother Mateusz last spring.", {("name", "Mateusz")}),
    ("Guardian Leticia Montemayor has power of attorney.", {("name", "Leticia")}),
    ("You can reach the niece at (312) 448-9017 after five.", {("phone", "(312)")}),
    ("Phone 415-682-3390 rings through to the ward.", {("phone", "415")}),
    ("Her mobile is +44 20 7946 0958 while abroad.", {("phone", "+44")}),
    ("Fax the form to 617.903.2284 before noon.", {("phone", "617")}),
    ("Cell: 2069951147, leave a message.", {("phone", "206")}),
    ("Call +1 (702) 331-8846 on arrival.", {("phone", "+1")}),
    ("Number is seven oh two four four one nine nine eight three.", {("phone", "seven")}),
    ("Contact the son, tel. 646 218 7735.", {("phone", "646")}),
    ("His German number is +49 30 901820 if needed.", {("phone", "+49")}),
    ("Text 503-771-2098 once you are parked outside.", {("phone", "503")}),
    ("SSN 612-48-9031 was verified at intake.", {("id_number", "612")}),
    ("Social security number: 401-77-2256.", {("id_number", "401")}),
    ("MRN 77120934 belongs to the same person.", {("id_number", "77120934")}),
    ("Her A-number is A203-556-871 per the card.", {("id_number", "A203")}),
    ("Medical record number 5561082 was merged last year.", {("id_number", "5561082")}),
    ("Insurance ID KXB40912277 is active.", {("id_number", "KXB")}),
    ("Medicaid no. 884201775 expired in March.", {("id_number", "884201775")}),
    ("Member ID: H774-1093 on the plan card.", {("id_number", "H774")}),
    ("Alien number A 099 312 447 appears on both forms.", {("id_number", "A 099")}),
    ("ssn is 523 66 1180, see scan.", {("id_number", "523")}),
    ("Deliver the chair to 4417 Maple Hollow Crescent.", {("address", "4417")}),
    ("She now lives at 12 Rue Cler with family.", {("address", "12 Rue")}),
    ("Home is 2208 N Ashland Avenue, second floor.", {("address", "2208")}),
    ("Pick up at 95 Old Mill Road, ring twice.", {("address", "95")}),
    ("Mail goes to P.O. Box 1187.", {("address", "P.O.")}),
    ("Address: 731 Wetherby Lane, Apt 4.", {("address", "731")}),
    ("He resides at 1600 Orchard Terrace.", {("address", "1600")}),
    ("Drop off at 58 East 14th Street please.", {("address", "58")}),
    ("They moved to 3920 Paseo del Norte in June.", {("address", "3920")}),
    ("The house at 811 Calle Luna has a ramp.", {("address", "811")}),
    ("Write to h.lindqvist@postbox.example for copies.", {("email", "h.lindqvist")}),
    ("E-mail: mona_98@clinic.example.org", {("email", "mona_98")}),
    ("Reach him at t.abara (at) mailhost (dot) example", {("email", "t.abara")}),
    ("send scans to wardseven@records.example.net today", {("email", "wardseven")}),
    ("copy ravi dot menon at inbox dot example dot com on it", {("email", "ravi")}),
    ("Reports go to quill+daily@svc.example.", {("email", "quill+daily")}),
    # nothing here is personal
    ("Order 55210984 ships Tuesday with two spare tanks.", set()),
    ("Authorization 7710023381 covers six round trips.", set()),
    ("Unit 14 arrived at Maplewood Hospital at 0915.", set()),
    ("Apgar score 9 at five minutes, Foley removed.", set()),
    ("Claim 20417733 denied, resubmit by 03/14/25.", set()),
    ("Weight 212 lb, needs 3 person lift and 20 ft ramp.", set()),
    ("Transfer from Cedar Grove Clinic to Lakeside Rehab.", set()),
    ("Oxygen 4 L by mask, Parkinson disease, no known allergies.", set()),
    ("Serial 90015527 on the Hoyer lift was replaced.", set()),
    ("Patient walked 40 steps with walker, pain 3 of 10.", set()),
    ("Lot 48-2210-77 was recalled by the manufacturer.", set()),
]


@pytest.fixture(scope="module")
def fitted(spark):
    d = DATA / "sf0.01"
    if not d.exists():
        pytest.skip("no test tables here")
    texts, _, model = queries._p2_model(spark, str(d))
    return model, texts.gaz


def test_recall_and_precision_by_kind(fitted):
    model, gaz = fitted
    want, hit, extra, missed = Counter(), Counter(), Counter(), []
    for text, items in SENTENCES:
        got = [(k, text[a:]) for k, a, _ in model.items(text, gaz)]
        for kind, begins in items:
            want[kind] += 1
            ok = any(k == kind and rest.startswith(begins) for k, rest in got)
            hit[kind] += ok
            if not ok:
                missed.append((kind, begins, got))
        extra.update((k, rest[:25]) for k, rest in got if not any(k == x and rest.startswith(b) for x, b in items))
    print({k: (hit[k], want[k]) for k in want}, extra, missed, sep="\n")
    for kind in pii.KINDS:
        assert hit[kind] >= 0.9 * want[kind], (kind, missed)
    assert sum(extra.values()) <= 0.1 * sum(want.values()), extra
