from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rollcall.functions import text as X
from rollcall.functions import vectors as V
from rollcall.functions.boxes import Box, argsort_desc, every_second, fps_grid, linspace_indices, time_grid, time_to_frame, track_audio_window, waveform_slice


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def s(x):
    return F.lit(x)


def test_names(spark):
    assert one(spark, X.normalise_name(s("The Grinch (2018)"))) == ("grinch",)
    assert one(spark, X.normalise_name(s("A  Bug's Life"))) == ("bugs life",)
    assert one(spark, X.clean_name(s("Shrek (character)")), X.clean_name(s("A/B_C")), X.clean_name(s("(all)"))) == ("Shrek", "A-B C", "(all)")
    assert one(spark, X.title_id(s("x/title/tt0090633/")), X.title_id(F.lit(None).cast("string"))) == ("tt0090633", None)
    assert one(spark, X.voiced_role(s("Red (voice) / Blue")), X.voiced_role(s("Additional voices (voice)"))) == ("Red", None)
    assert one(spark, X.drop_voice_suffix(s("Red (voice)"), True)) == ("Red",)


def test_urls(spark):
    url = s("https://w.fandom.com/wiki/Category:A_B")
    assert one(spark, X.wiki_api(url), X.wiki_title(url)) == ("https://w.fandom.com/api.php", "Category:A B")
    assert one(spark, X.wiki_title(s("https://w.org/wiki/A+B%20C")), X.wiki_title(s("https://w.org/plain"))) == ("A+B C", "/plain")
    assert one(spark, X.rasterise_url(s("http://a/b.SVG?x=1")), X.rasterise_url(s("http://a/b.png"))) == ("http://a/b.SVG/scale-to-width-down/800?x=1", "http://a/b.png")


def test_infobox(spark):
    wiki = "{{Infobox\n| Image1 = [[File: Fiona.png|thumb]]\n| other = x.jpg}}"
    assert one(spark, X.infobox_file(s(wiki)), X.infobox_file(s("| image = " + "y" * 500 + ".png")), X.infobox_file(s("none"))) == ("File:Fiona.png", None, None)


def test_text_rules(spark):
    assert one(spark, X.junk_title(s("List of x")), X.junk_title(s("A/B")), X.junk_title(s("Shrek"))) == (True, True, False)
    assert one(spark, X.generic_role(s("Boy")), X.generic_role(s("Beast Boy")), X.generic_role(s("Grape #3"))) == (True, False, True)
    assert one(spark, X.fits_length(s("one")), X.fits_length(s("one two")), X.fits_length(s(""))) == (False, True, False)
    assert one(spark, X.word_count(s("")), X.word_count(s(" a  b ")), X.word_count(F.lit(None).cast("string"))) == (0, 2, 0)
    assert one(spark, X.word_budget(s(2.75))) == (11,)
    assert one(spark, X.character_list(F.array(s("A"), s("B")), F.array(s("red"), s("blue")))) == ("A (red), B (blue)",)
    assert one(spark, X.fill_template("{a} and {b}", a=s("x"), b=F.lit(None))) == ("x and ",)
    assert one(spark, X.stem(s("/a/b.c.mp4")), X.parent(s("/y/b.mp4")), X.basename(s("x"))) == ("b.c", "y", "x")
    assert one(spark, X.repair_output(s("1. Main characters: x")), X.repair_output(s("{'summarised_AD': 'hi}'}"))) == ("", "hi")


def test_vectors(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, V.cosine(a(0.0, 0.0), a(1.0, 0.0)), V.cosine(a(3.0, 4.0), a(3.0, 4.0))) == (0.0, 1.0)
    assert one(spark, V.normalise(a(3.0, 4.0)), V.normalise(a(0.0, 0.0))) == ([0.6, 0.8], [0.0, 0.0])
    with pytest.raises(Exception, match="unequal"):
        one(spark, V.cosine(a(1.0), a(1.0, 2.0)))
    assert one(spark, V.hamming(F.lit(5), F.lit(6))) == (2,)
    assert one(spark, V.contrast(a(1.0), a(1.0), F.lit(None).cast("array<double>"))) == (-math.inf,)
    assert one(spark, V.minmax_scale(s(3.0), s(1.0), s(5.0)), V.minmax_scale(s(3.0), s(3.0), s(3.0))) == (0.5, 3.0)
    assert one(spark, V.log_softmax(a(0.0, 0.0)))[0] == pytest.approx([-math.log(2)] * 2)


def box(*v):
    return Box(*(F.lit(x) for x in v))


def test_boxes(spark):
    a, b = box(0, 0, 2, 2), box(1, 1, 3, 3)
    assert one(spark, a.iou(b))[0] == pytest.approx(1 / 7)
    assert one(spark, a.iou_eps(b))[0] == pytest.approx(1 / 7.000001)
    assert one(spark, box(0, 0, 0, 0).iou(box(0, 0, 0, 0))) == (None,)
    assert one(spark, box(0, 0, 36, 36).area() >= 1296, box(0, 0, 36, 35).area() >= 1296) == (True, False)
    assert one(spark, a.containment(box(1, 0, 3, 2)), a.containment(box(0, 0, 0, 5))) == (0.5, 0.0)
    assert one(spark, box(-1, 5, 3, 9).slide_into(F.lit(10), F.lit(8)).array()) == ([0, 4, 4, 8],)
    with pytest.raises(Exception, match="exceeds"):
        one(spark, box(0, 0, 11, 1).slide_into(F.lit(10), F.lit(8)).array())
    assert one(spark, box(0, 0, 2, 2).recentre(F.lit(4), F.lit(4)).array()) == ([-1.0, -1.0, 3.0, 3.0],)
    assert one(spark, box(5, 5, 9, 9).clipped_array(F.lit(4), F.lit(4))) == (None,)
    assert one(spark, box(0, 0, 10, 10).pad(F.lit(100), F.lit(100)).array()) == ([0.0, 0.0, 11.0, 11.0],)


def test_time(spark):
    assert one(spark, linspace_indices(F.lit(32))) == ([2 * i for i in range(16)],)
    assert one(spark, linspace_indices(F.lit(31), 4, to_last=True)) == ([0, 10, 20, 30],)
    assert one(spark, every_second(F.array(*map(F.lit, "abcd")))) == (["a", "c"],)
    assert one(spark, fps_grid(F.lit(10), F.lit(4))) == ([2, 6],)
    assert one(spark, time_to_frame(s(1.99), F.lit(25)), time_to_frame(s(9.0), F.lit(25), F.lit(100))) == (49, 99)
    assert one(spark, *track_audio_window(F.lit(0), F.lit(24), F.lit(25))) == (0.0, 1.0)
    assert len(one(spark, time_grid(s(0.0), s(0.03), 0.01))[0]) == 4
    assert one(spark, waveform_slice(F.sequence(F.lit(0), F.lit(9)), s(0.2), s(0.5), 10)) == ([2, 3, 4],)
    assert one(spark, argsort_desc(F.array(s(1.0), s(3.0), s(3.0)))) == ([1, 2, 0],)
