"""Queries that feed all of their input to the operator."""

from pyspark.sql import functions as F

from pagestrata import plans
from pagestrata.sources import derived

FOLDER = "/root/testdata/sf0.001"


def test_cluster_boxes_takes_every_fill(spark):
    found = plans.QUERIES["cluster_boxes"](spark, FOLDER).agg(F.sum("members")).first()[0]
    assert found == derived.fills(spark, FOLDER).count()


def test_every_word_is_dealt_to_a_piece(spark):
    found = plans.QUERIES["split_ocr_pieces"](spark, FOLDER).agg(F.count("*"), F.max("piece")).first()
    assert found[0] == derived.scanned_words(spark, FOLDER).count() and found[1] > 1
