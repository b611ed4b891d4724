import time

import pytest

from quietlines.llm import credentials

LONG = 4_000_000
BITS = [
    "a", "aB3+", "a.", "a-", "_", " ", "\t", "\n", "[", "[-", "://", "a://b", "http://u:", "password ", "password= ", "password='", 'token="\\', "token is ", "${", "$(", "{{", "${{ ", "$a", "-----BEGIN PRIVATE KEY-----",
    "curl ", "curl -u ", "docker login ", "echo x ", "echo x | ", "printf 'x' ", "bearer ", "Authorization: ", "pgpass x:12:", "x:12:x:", "eyJaaaaaaaa.", "sk-", "ghp_", "<password>", "--token ", "('password', ", "/a", "x*",
]


@pytest.mark.parametrize("bit", BITS)
def test_time_grows_with_the_text_alone(bit):
    def spent(size: int) -> float:
        text = bit * (size // len(bit))
        began = time.perf_counter()
        credentials.find_credentials(text)
        return time.perf_counter() - began

    short = max(spent(LONG // 40), 0.01)
    assert spent(LONG // 10) < 12 * short, bit


@pytest.mark.parametrize("run", ["aB3+", "a", "x.y-z"])
def test_one_long_run_is_quick(run):
    began = time.perf_counter()
    credentials.find_credentials("pgpass " + run * (LONG // len(run)))
    assert time.perf_counter() - began < 10.0


def test_many_findings_do_not_slow_the_choice():
    text = "TOKEN=Zx9kQ2mB7vLp4T\n" * 20_000
    began = time.perf_counter()
    assert len(credentials.find_credentials(text)) == 20_000 and time.perf_counter() - began < 5.0
