"""The page parser on its own: texts, cells and ends of odd pages, and its time."""

from __future__ import annotations

import time

import pytest

from casework.operators.pages import CasePage, page_values


def cells(page):
    p = CasePage(page)
    return [p.text[c.begin:c.end].strip() for c in p.cells]


@pytest.mark.parametrize("page, text", [
    ("a < b <3 c", "a < b <3 c"),
    ("a<b>b</b>c", "abc"),
    ("x &amp; y &#227; &lt;td&gt;", "x & y ã <td>"),
    ("<!-- <td>x</td> -->y<!-->z<!--->w<!-- a --!>v<!-- open <p>x", "yzwv"),
    ("<!DOCTYPE html>a<?php x ?>b</ x>c</>d</3>e", "abcde"),
    ("a<b title='>' alt=\"<td>\" x=>b</b>c", "abc"),
    ("a<b \">c", "ac"),
    ("a<b x=\"open>c<p>d", "a"),
    ("a<b c", "a"),
    ("a</b", "a"),
    ("a</", "a</"),
    ("a<", "a<"),
    ("<script>if (a<b) '</td>'</script>x<style><p></style>y", "xy"),
    ("<title>a &amp; <b>c</title>d", "a & <b>cd"),
    ("<textarea><td>x</textarea >y", "<td>xy"),
    ("<xmp>&amp;<b></xmp>z", "&amp;<b>z"),
    ("a<script>never closed <p>b", "a"),
    ("<noscript>a<b>b</b></noscript>c<template><td>d</td></template>", "c"),
    ("<SCRIPT>x</ScRiPt\n>y", "y"),
])
def test_text(page, text):
    assert CasePage(page).text.replace("\n", "") == text


@pytest.mark.parametrize("page, want", [
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<table><tr><td>a<table><tr><td>b</td></tr></table>c</td><td>d</td></tr></table>", ["a\nb" + "c", "b", "d"]),
    ("<td>a</td></tr></table>b<td>c", ["a", "c"]),
    ("<table><tr><td>a</td><th>h</th><td>b</td></tr></table>", ["a", "b"]),
    ("<td>a<b>b</td>c</b>", ["ab"]),
    ("<td>a<p>b<i>c", ["a\nbc"]),
])
def test_cells(page, want):
    assert [c.replace("\n\n", "\n").replace("\n\n", "\n") for c in cells(page)] == want


@pytest.mark.parametrize("tag", ["<div id=juizPrimeiraDivTable>", "<div class='x' ID = \"juizPrimeiraDivTable\">", "<div id='juizPrimeira&#68;ivTable' id=other>",
                                 "<div title=\" id=x \" id=juizPrimeiraDivTable />"])
def test_judge_by_id(tag):
    assert page_values(f"<span>no</span>{tag}<p><span> Ana <span>B.</span></span><span>x</span></p></div><span>y</span>")[1] == "Ana B."


@pytest.mark.parametrize("tag", ["<div id=x id=juizPrimeiraDivTable>", "<div data-id=juizPrimeiraDivTable>", "<div title=' id=juizPrimeiraDivTable'>"])
def test_other_attributes_are_no_id(tag):
    assert page_values(f"{tag}<span>Ana</span></div>")[1] == ""


def test_claimant_and_decision():
    table = "<table id='tablePartesPrincipais'><tr><td>x İ</td><td>Massa\n  &nbsp;falida</td><td>first</td></tr><tr><td>REQUERENTE</td></tr></table>"
    long = "Procedência " + "z" * 50
    assert page_values(table + "<td>Procedência</td>" + f"<td><b>{long}</b></td>")[2:] == ("first", None)
    assert page_values(f"<td>a<table><td>{long}</td></table></td>")[3] == "a\n\n" + long
    assert page_values("<td>Requerente</td><td>no table of parties</td>")[2] is None


N = 100_000


@pytest.mark.parametrize("page", [
    "<b>x" * N, "<b>x" * N + "</i>" * N, "<p id=a>" * N, "<td><table>x" * N, "<table><tr><td>" * N + "</td>" * N, "<td>Procedência " * N,
    "<table id=tablePartesPrincipais>" + "<tr><td>Requerente<td>x" * N, "<a x=\"1\" " * N + "\">", "<a x='" * N, "<a " * N, "< " * N, "<!-- " * N,
    "<script>" * N, "<title>x</titl" * N, "&" * N, "&amp" * N, "<div a=b=" * N, "<x =\"" * N + ">",
])
def test_time_follows_length(page):
    """100,000 elements, open, stray, nested or torn; a quadratic pass would take minutes."""
    page_values(page[:len(page) // 50])
    began = time.process_time()
    page_values(page)
    assert time.process_time() - began < 8
