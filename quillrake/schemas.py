"""Schemas of the rows that the harvest passes on."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, L, I = T.StringType(), T.BooleanType(), T.LongType(), T.IntegerType()  # noqa: E741


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


ARTICLE = _struct(provider_id=S, id=S, title=S, url=S, description=S, image_url=S, keywords=T.ArrayType(S), published_at=T.TimestampType())
EVENT = _struct(provider_id=S, provider_name=S, article=ARTICLE, collected_at=T.TimestampType())
PROVIDER = _struct(id=S, name=S, type=S, source_url=S, response_format=S, request_delay_ms=I, config=T.MapType(S, S))
SQS = _struct(queue_url=S, region=S, access_key_id=S, secret_access_key=S)
SNS = _struct(topic_arn=S, region=S, access_key_id=S, secret_access_key=S)
AZURE = _struct(connection_string=S, queue_name=S)
GCP = _struct(project_id=S, topic=S, credentials_file=S)
QUEUE = _struct(provider=S, aws=SQS, sns=SNS, azure=AZURE, gcp=GCP)
HTTP = _struct(url=S, method=S, headers=T.MapType(S, S), timeout_seconds=I)
SINK = _struct(id=S, type=S, enabled=B, queue=QUEUE, http=HTTP)
SEEN = _struct(article_id=S, expires_at=L)
DELIVERY = _struct(row_id=L, article_id=S, provider_id=S, sink_pos=I, sink_id=S, sink_type=S, ok=B, error=S)
NEWS = _struct(publication_date=S, keywords=S, title=S)
IMAGE = _struct(loc=S, title=S)
ENTRY = _struct(loc=S, news=NEWS, image=T.ArrayType(IMAGE))
RESPONSE = _struct(url=S, status=I, body=T.BinaryType(), error=S)
META = _struct(title=S, description=S, image_url=S)
