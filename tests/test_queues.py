import base64
import io
import json
import shutil
import subprocess
import urllib.error
import urllib.parse
from datetime import datetime, timezone

import pytest

from quillrake.operators import queues as Q
from quillrake.operators.delivery import queue_transport


class Answer(io.BytesIO):
    status = 200


def opener(asked, answers):
    def open_(request, timeout):
        asked.append(request)
        got = answers[len(asked) - 1]
        if isinstance(got, Exception):
            raise got
        return Answer(json.dumps(got).encode())

    return open_


def test_signature_of_the_published_example():
    """The example 'get-vanilla' of the published test suite of the signature."""
    got = Q.signed_headers("GET", "https://example.amazonaws.com/", b"", {}, "us-east-1", "service", "AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", datetime(2015, 8, 30, 12, 36, tzinfo=timezone.utc))
    assert got["Authorization"].endswith("Signature=5fa00fa31553b73ebf1942676e86291e8372ff2a2260956d9b8aae1d763fbf31")


AWS = {"queue_url": "https://sqs.r1.example/1/jobs", "topic_arn": "arn:1", "region": "r1", "access_key_id": "k", "secret_access_key": "s"}


@pytest.mark.parametrize(("client", "host", "want"), [(Q.sqs, "sqs.r1.example", {"Action": "SendMessage", "MessageBody": "{}", "MessageAttribute.1.Value.StringValue": "p"}), (Q.sns, "sns.r1.amazonaws.com", {"Action": "Publish", "TopicArn": "arn:1", "Message": "{}", "MessageAttributes.entry.1.Name": "provider_id"})])
def test_aws_requests(client, host, want):
    asked = []
    client(AWS, "{}", {"provider_id": "p"}, opener(asked, [{}]))
    form = dict(urllib.parse.parse_qsl(asked[0].data.decode()))
    assert asked[0].host == host and want.items() <= form.items() and "Credential=k/" in asked[0].headers["Authorization"]


def test_a_refusal_is_the_attempts_error():
    refused = urllib.error.HTTPError("u", 403, "no", {}, io.BytesIO(b" denied "))
    send = queue_transport({"aws-sqs": lambda s, b, a: Q.sqs(s, b, a, opener([], [refused]))})
    assert send("{}", "p", {"queue": {"provider": "aws-sqs", "aws": AWS}}) == "queue aws-sqs: status 403: denied"


@pytest.mark.skipif(shutil.which("openssl") is None, reason="no openssl")
def test_pubsub_with_a_key_file(tmp_path):
    key, public = tmp_path / "k.pem", tmp_path / "p.pem"
    subprocess.run(["openssl", "genpkey", "-algorithm", "RSA", "-pkeyopt", "rsa_keygen_bits:2048", "-out", key], check=True, capture_output=True)
    subprocess.run(["openssl", "rsa", "-in", key, "-pubout", "-out", public], check=True, capture_output=True)
    account = tmp_path / "a.json"
    account.write_text(json.dumps({"client_email": "m@x.example", "token_uri": "https://token.example/t", "private_key": key.read_text()}))
    asked, settings = [], {"project_id": "p1", "topic": "t1", "credentials_file": str(account)}
    Q._TOKENS.clear()
    Q.pubsub(settings, "é", {"provider_id": "x"}, opener(asked, [{"access_token": "tok", "expires_in": 3600}, {"messageIds": ["1"]}]))
    text, _, signature = dict(urllib.parse.parse_qsl(asked[0].data.decode()))["assertion"].rpartition(".")
    (tmp_path / "s").write_bytes(base64.urlsafe_b64decode(signature + "=" * (-len(signature) % 4)))
    (tmp_path / "m").write_text(text)
    subprocess.run(["openssl", "dgst", "-sha256", "-verify", public, "-signature", tmp_path / "s", tmp_path / "m"], check=True, capture_output=True)
    message = json.loads(asked[1].data)["messages"][0]
    assert base64.b64decode(message["data"]).decode() == "é" and message["attributes"] == {"provider_id": "x"} and asked[1].headers["Authorization"] == "Bearer tok"
    again = []
    Q.pubsub(settings, "b", {}, opener(again, [{"messageIds": ["2"]}]))  # the token is kept
    assert len(again) == 1
    with pytest.raises(Q.QueueError):
        Q.pubsub(settings, "b", {}, opener([], [{}]))
