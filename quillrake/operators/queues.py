"""Clients of message queues over plain HTTP: SQS, SNS and Pub/Sub, without their libraries.

Each client is a function of a sink's settings, a message and its attributes; it waits for the acknowledgement and
raises on failure. They run on executors, inside of ``delivery.deliver``.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

TIMEOUT_S = 15

#: Versions of the two query interfaces; where Pub/Sub and its tokens are.
SQS_VERSION, SNS_VERSION = "2012-11-05", "2010-03-31"
PUBSUB, SCOPE = "https://pubsub.googleapis.com/v1", "https://www.googleapis.com/auth/pubsub"
METADATA_TOKEN = "http://metadata.google.internal/computeMetadata/v1/instance/service-accounts/default/token"

Opener = Callable[..., object]


class QueueError(RuntimeError):
    """A queue didn't take a message."""


def _call(request: urllib.request.Request, opener: Opener | None) -> bytes:
    try:
        with (opener or urllib.request.urlopen)(request, timeout=TIMEOUT_S) as r:
            return r.read(1 << 20)
    except urllib.error.HTTPError as e:
        raise QueueError(f"status {e.code}: {e.read()[:512].decode('utf-8', 'ignore').strip()}") from e


def signed_headers(method: str, url: str, body: bytes, headers: dict[str, str], region: str, service: str, key_id: str, secret: str, now: datetime) -> dict[str, str]:
    """Headers of a request signed by version 4 of the AWS signature."""
    at = urllib.parse.urlsplit(url)
    stamp, day = now.strftime("%Y%m%dT%H%M%SZ"), now.strftime("%Y%m%d")
    signed = {k.lower(): v.strip() for k, v in headers.items()} | {"host": at.netloc, "x-amz-date": stamp}
    names = ";".join(sorted(signed))
    query = "&".join(f"{k}={v}" for k, v in sorted((urllib.parse.quote(k, "-_.~"), urllib.parse.quote(v, "-_.~")) for k, v in urllib.parse.parse_qsl(at.query, keep_blank_values=True)))
    canonical = "\n".join([method, urllib.parse.quote(at.path or "/", "/-_.~%"), query, *[f"{k}:{signed[k]}" for k in sorted(signed)], "", names, hashlib.sha256(body).hexdigest()])
    scope = f"{day}/{region}/{service}/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(canonical.encode()).hexdigest()])
    key = f"AWS4{secret}".encode()
    for part in (day, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    signature = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    return headers | {"X-Amz-Date": stamp, "Authorization": f"AWS4-HMAC-SHA256 Credential={key_id}/{scope}, SignedHeaders={names}, Signature={signature}"}


def _query(url: str, service: str, settings: dict, form: dict[str, str], opener: Opener | None) -> None:
    body = urllib.parse.urlencode(form).encode()
    headers = {"Content-Type": "application/x-www-form-urlencoded"}
    headers = signed_headers("POST", url, body, headers, settings["region"], service, settings["access_key_id"], settings["secret_access_key"], datetime.now(timezone.utc))
    _call(urllib.request.Request(url, data=body, headers=headers, method="POST"), opener)


def _attributes(prefix: str, attributes: dict[str, str]) -> dict[str, str]:
    out = {}
    for k, (name, value) in enumerate(attributes.items(), 1):
        out |= {f"{prefix}.{k}.Name": name, f"{prefix}.{k}.Value.DataType": "String", f"{prefix}.{k}.Value.StringValue": value}
    return out


def sqs(settings: dict, body: str, attributes: dict[str, str], opener: Opener | None = None) -> None:
    """Send a message to an SQS queue."""
    form = {"Action": "SendMessage", "Version": SQS_VERSION, "MessageBody": body}
    _query(settings["queue_url"], "sqs", settings, form | _attributes("MessageAttribute", attributes), opener)


def sns(settings: dict, body: str, attributes: dict[str, str], opener: Opener | None = None) -> None:
    """Publish a message to an SNS topic."""
    form = {"Action": "Publish", "Version": SNS_VERSION, "TopicArn": settings["topic_arn"], "Message": body}
    _query(f"https://sns.{settings['region']}.amazonaws.com/", "sns", settings, form | _attributes("MessageAttributes.entry", attributes), opener)


def _der(data: bytes, at: int) -> tuple[int, bytes, int]:
    """(tag, content, end) of the DER element that begins at a place."""
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return tag, data[at : at + size], at + size


def _children(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, content, at = _der(data, at)
        out.append((tag, content))
    return out


def rsa_key(pem: str) -> tuple[int, int]:
    """(modulus, private exponent) of an RSA key in PEM, PKCS 8 or PKCS 1."""
    raw = base64.b64decode("".join(x for x in pem.strip().splitlines() if not x.startswith("-----")))
    parts = _children(_der(raw, 0)[1])
    if len(parts) > 2 and parts[1][0] == 0x30:  # PKCS 8 wraps the key in an octet string
        parts = _children(_der(parts[2][1], 0)[1])
    return int.from_bytes(parts[1][1], "big"), int.from_bytes(parts[3][1], "big")


#: Fixed value: what stands before a SHA-256 digest in a signature of PKCS 1.5.
_SHA256_INFO = bytes.fromhex("3031300d060960864801650304020105000420")


def rs256(pem: str, message: bytes) -> bytes:
    """RSA signature (PKCS 1.5, SHA-256) of a message."""
    n, d = rsa_key(pem)
    size = (n.bit_length() + 7) // 8
    tail = _SHA256_INFO + hashlib.sha256(message).digest()
    padded = b"\x00\x01" + b"\xff" * (size - len(tail) - 3) + b"\x00" + tail
    return pow(int.from_bytes(padded, "big"), d, n).to_bytes(size, "big")


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


_TOKENS: dict[str, tuple[str, float]] = {}


def _token(credentials_file: str, opener: Opener | None) -> str:
    """Access token of a service account's key file, or of the machine where no file is given; kept until it expires."""
    got = _TOKENS.get(credentials_file)
    if got and got[1] > time.time() + 60:
        return got[0]
    if credentials_file:
        account, now = json.loads(Path(credentials_file).read_text(encoding="utf-8")), int(time.time())
        claims = {"iss": account["client_email"], "scope": SCOPE, "aud": account["token_uri"], "iat": now, "exp": now + 3600}
        text = f"{_b64(json.dumps({'alg': 'RS256', 'typ': 'JWT'}).encode())}.{_b64(json.dumps(claims).encode())}"
        form = {"grant_type": "urn:ietf:params:oauth:grant-type:jwt-bearer", "assertion": f"{text}.{_b64(rs256(account['private_key'], text.encode()))}"}
        request = urllib.request.Request(account["token_uri"], data=urllib.parse.urlencode(form).encode(), method="POST")
    else:
        request = urllib.request.Request(METADATA_TOKEN, headers={"Metadata-Flavor": "Google"})
    answer = json.loads(_call(request, opener))
    _TOKENS[credentials_file] = answer["access_token"], time.time() + int(answer.get("expires_in", 0))
    return answer["access_token"]


def pubsub(settings: dict, body: str, attributes: dict[str, str], opener: Opener | None = None) -> None:
    """Publish a message to a Pub/Sub topic."""
    token = _token((settings.get("credentials_file") or "").strip(), opener)
    url = f"{PUBSUB}/projects/{settings['project_id']}/topics/{settings['topic']}:publish"
    data = json.dumps({"messages": [{"data": base64.b64encode(body.encode()).decode(), "attributes": attributes}]}).encode()
    answer = json.loads(_call(urllib.request.Request(url, data=data, headers={"Authorization": f"Bearer {token}", "Content-Type": "application/json"}, method="POST"), opener))
    if not answer.get("messageIds"):
        raise QueueError("no message id came back")


#: Client of each kind of queue that a registry may name.
CLIENTS = {"aws-sqs": sqs, "aws-sns": sns, "gcp": pubsub}
