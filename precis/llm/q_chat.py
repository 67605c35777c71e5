"""Query of the chat formatting operator."""

from .chat import chat_digests, format_chats
from .common import table
from .registry import register


@register("op2_chat_format")
def op2_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT bigint(-7) AS conv_id, inline(array(struct(bigint(0) AS turn, 'user' AS role), "
                      "struct(bigint(1) AS turn, 'assistant' AS role)))").selectExpr("*", "'</s>[INST] ok [/INST]' AS text")
    return chat_digests(format_chats(turns.unionByName(probe)))
