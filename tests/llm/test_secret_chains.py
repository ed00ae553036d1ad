"""Novel spans against a plain version, in linear time, with whole tokens."""

import random
import string
import time

from hustings.llm import secret_scan as s


def plain_spans(text, known):
    """The definition, comparing with every span and walking every chain anew."""
    taken, out, judged = [(a, b) for a, b, _ in known], [], {}

    def judge(a, b, sure=False):
        if sure or (a, b) not in judged:
            judged[a, b] = True
            if not any(x < b and a < y for x, y in taken + out):
                found = text[a:b]
                mixed = any(c.isdigit() for c in found) and any(c.isalpha() for c in found)
                judged[a, b] = sure or mixed and s.incompressible(found, text[max(0, a - s.AROUND) : a] + text[b : b + s.AROUND])
                if judged[a, b]:
                    out.append((a, b))
        return judged[a, b]

    def onward(end):
        if joint := s.JOINT.match(text, end):
            m = s.CANDIDATE.match(text, joint.end())
            judge(*m.span(), sure=True)
            return onward(m.end())
        if gap := s.GAP.match(text, end):
            m = s.CANDIDATE.match(text, gap.end())
            if m and judge(*m.span()):
                return onward(m.end())
            if m := s.LAST.match(text, gap.end()):
                judge(*m.span(), sure=True)

    runs, reached = [m.span() for m in s.CANDIDATE.finditer(text)], 0
    for word in s.CONTEXT.finditer(text):
        for a, b in runs:
            if word.start() - s.NEAR <= b <= word.start() and judge(a, b):
                onward(b)
        at = max(word.end(), reached)
        for a, b in runs:
            if b >= at + 16 and max(a, at) <= word.end() + s.NEAR:
                a, reached = max(a, at), b
                at = b
                if judge(a, b):
                    onward(b)
    return sorted((a, b, "novel") for a, b in out)


def token(rng, n=None):
    return "".join(rng.choices(string.ascii_letters + string.digits, k=n or rng.randint(16, 60)))


def test_spans_equal_the_plain_version():
    rng = random.Random(23)
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 40)):
            parts.append(rng.choice([token(rng), token(rng), "bearer ", "password=", "private ", " ", "\n", ".", ":", "~", '" + "', " some words here ", "a_long_identifier_name", token(rng, 9) + "==", "AKIA" + token(rng).upper(), "0123456789abcdef" * 2]))
        text = "".join(parts)
        known = s.base_spans(text)
        assert s.novel_spans(text, known) == plain_spans(text, known), text


def test_many_secrets_in_one_text_take_linear_time():
    took = []
    for mb in (0.25, 1.0):
        n = int(mb * 1e6 / 24)
        text = "".join(f"token=abcdefghij{k:07d}\n" for k in range(n))
        began = time.process_time()
        known, novel = s.scan_text(text)
        took.append(time.process_time() - began)
        assert len(known) == n and not novel
    assert took[1] < 8 and took[1] < 10 * took[0] + 0.5
    rng = random.Random(1)
    chain = "bearer " + "\n".join(token(rng, 40) for _ in range(3000))
    began = time.process_time()
    assert len(s.scan_text(chain)[1]) > 2000
    assert time.process_time() - began < 20


def test_a_web_token_is_masked_whole():
    rng = random.Random(4)
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9." + token(rng, 180) + "." + token(rng, 43)
    text = f"Authorization: Bearer {jwt} and so on."
    left = s.masked(text, sum(s.scan_text(text), []))
    assert jwt.split(".")[1] not in left and jwt.split(".")[2] not in left and left.endswith("and so on.")


def test_recall_and_precision_on_planted_secrets():
    rng = random.Random(9)
    found = wrong = 0
    for _ in range(300):
        value = token(rng, rng.randint(20, 44))
        if not any(c.isdigit() for c in value):
            value += "7"
        text = f"the {rng.choice(['private key', 'credential', 'authorization', 'client_key'])} of the server is {value} as we said"
        found += any(text[a:b] == value for a, b, _ in s.scan_text(text)[1])
        plain = f"the private notes are in {rng.choice(['annual_report', 'getElementById', 'src/components/forms'])}_{rng.choice(['final_version', 'for_the_server', 'of_all_users'])} as we said"
        wrong += bool(s.scan_text(plain)[1])
    assert found >= 295 and wrong == 0
