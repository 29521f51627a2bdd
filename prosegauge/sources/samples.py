"""Four short texts of our own to try things on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLES = {
    "plain": "The bus was late. We stood in the rain and talked about the game. Tom had brought tea in a flask, so no one minded much.\n\nWhen it came at last, the driver waved. We sat at the back and sang all the way home.",
    "official": "The implementation of the revised allocation was approved by the committee in March 2019. Its consideration of alternative arrangements had been delayed by the investigation.\n\nParticipation in the consultation was limited to organisations that were registered before the announcement.",
    "numbers": "In 2021 the shop sold 1,250 lamps, 340 chairs and 12 beds. Sales rose by 3.5 per cent in May.\n\nDr. Hale paid 99 dollars on Jan. 5. Why so much? Nobody knew.",
    "varied": "Stop! The whole valley, which had been quiet since the last of the travellers packed their tents and went north along the river, was suddenly alive with bells. Why? A wedding. It was perhaps the very first in years.",
}


def samples(spark: SparkSession) -> DataFrame:
    """doc_id and text."""
    return spark.createDataFrame(list(SAMPLES.items()), "doc_id string, text string")
