"""Workbook descriptions to models and views."""

import zipfile
from datetime import datetime
from xml.etree import ElementTree

import pytest

from lattiq.errors import UnsupportedCalc
from lattiq.plans.view import run_view
from lattiq.sources import workbooks as wb

BOOK = """<workbook>
 <datasources>
  <datasource name='Parameters' hasconnection='false'>
   <column caption='Floor' datatype='integer' name='[Parameter 1]' param-domain-type='range' value='5'><calculation class='x' formula='5'/><range min='0' max='10' granularity='5'/></column>
   <column caption='Pick' datatype='string' name='[Parameter 2]' value='&quot;a&quot;'><members><member value='&quot;a&quot;'/><member value='&quot;b&quot;'/></members></column>
  </datasource>
  <datasource caption='Shop' name='federated.shop'>
   <connection class='federated'>
    <named-connections><named-connection name='pg.1'><connection class='postgres' server='h' dbname='d'/></named-connection></named-connections>
    <relation type='collection'>
     <relation connection='pg.1' name='Visits' table='[public].[visits]' type='table'/>
     <relation connection='pg.1' name='Stores' type='text'>SELECT * FROM stores</relation>
    </relation>
    <metadata-records>
     <metadata-record class='column'><remote-name>amt</remote-name><local-name>[Amount]</local-name><parent-name>[Visits]</parent-name><local-type>real</local-type></metadata-record>
     <metadata-record class='column'><remote-name>at</remote-name><local-name>[Day]</local-name><parent-name>[Visits]</parent-name><local-type>datetime</local-type></metadata-record>
     <metadata-record class='column'><remote-name>store</remote-name><local-name>[store]</local-name><parent-name>[Visits]</parent-name><local-type>integer</local-type></metadata-record>
     <metadata-record class='column'><remote-name>id</remote-name><local-name>[id]</local-name><parent-name>[Stores]</parent-name><local-type>integer</local-type></metadata-record>
     <metadata-record class='column'><remote-name>town</remote-name><local-name>[Town]</local-name><parent-name>[Stores]</parent-name><local-type>string</local-type></metadata-record>
     <metadata-record class='column'><remote-name>geo</remote-name><local-name>[Geo]</local-name><parent-name>[Stores]</parent-name><local-type>spatial</local-type></metadata-record>
    </metadata-records>
   </connection>
   <column caption='Big' datatype='boolean' name='[Calculation_1]' role='dimension'><calculation formula='[Amount] &gt; [Parameters].[Parameter 1]'/></column>
   <column caption='Mean' datatype='real' name='[Calculation_2]' role='measure'><calculation formula='SUM([Amount]) / COUNT([Amount])'/></column>
   <column caption='Size' datatype='integer' name='[Amount (bin)]' role='dimension'><calculation class='bin' formula='[Amount]' peg='0' size='4'/></column>
   <column caption='Where' datatype='string' name='[Town (group)]' role='dimension'><calculation class='categorical-bin' column='[Town]'><bin value='&quot;North&quot;'><value>&quot;Oslo&quot;</value></bin></calculation></column>
   <column caption='City' datatype='string' name='[Town]' role='dimension'/>
   <object-graph><objects>
     <object id='v'><properties><relation name='Visits' type='table'/></properties></object>
     <object id='s'><properties><relation name='Stores' type='text'/></properties></object></objects>
    <relationships><relationship><expression op='='><expression op='[store]'/><expression op='[id]'/></expression><first-end-point object-id='v'/><second-end-point object-id='s'/></relationship></relationships></object-graph>
  </datasource>
 </datasources>
 <worksheets>
  <worksheet name='Running'><table><view><datasource-dependencies datasource='federated.shop'>
    <column datatype='real' name='[Amount]' role='measure'/><column caption='City' datatype='string' name='[Town]' role='dimension'/><column datatype='datetime' name='[Day]' role='dimension'/>
    <column-instance column='[Amount]' derivation='Sum' name='[cum:sum:Amount:qk]'><table-calc type='CumTotal' aggregation='Sum' ordering-type='Rows'/></column-instance>
    <column-instance column='[Day]' derivation='Month' name='[mn:Day:ok]'/>
    <column-instance column='[Town]' derivation='None' name='[none:Town:nk]'/></datasource-dependencies>
    <filter class='categorical' column='[federated.shop].[none:Town:nk]'><groupfilter function='except'><groupfilter function='level-members'/><groupfilter function='member' member='&quot;Bergen&quot;'/></groupfilter></filter>
    <filter class='quantitative' column='[federated.shop].[none:Amount:qk]'><min>1</min></filter></view>
   <rows>([federated.shop].[none:Town:nk] / [federated.shop].[cum:sum:Amount:qk])</rows><cols>[federated.shop].[mn:Day:ok]</cols></table></worksheet>
  <worksheet name='Groups'><table><view><datasource-dependencies datasource='federated.shop'>
    <column caption='Where' datatype='string' name='[Town (group)]' role='dimension'/><column caption='Mean' datatype='real' name='[Calculation_2]' role='measure'><calculation formula='x'/></column></datasource-dependencies>
    <computed-sort column='[federated.shop].[Town (group)]' direction='DESC' using='[federated.shop].[Calculation_2]'/></view>
   <rows>[federated.shop].[Town (group)]</rows><cols>[federated.shop].[Calculation_2]</cols></table></worksheet>
  <worksheet name='Odd'><table><view/><rows>[federated.shop].[x]</rows><cols/><view><filter/></view></table></worksheet>
  <worksheet name='Pane'><table><view><datasource-dependencies datasource='federated.shop'><column datatype='real' name='[Amount]' role='measure'/>
    <column-instance column='[Amount]' derivation='Sum' name='[p]'><table-calc type='PctDiff' ordering-type='CellInPane'/></column-instance></datasource-dependencies></view><rows>[federated.shop].[p]</rows></table></worksheet>
 </worksheets></workbook>"""


@pytest.fixture(scope="module")
def book():
    return wb.parse(BOOK)


@pytest.fixture(scope="module")
def model(spark, book):
    rows = [(2.0, 1, 1), (6.0, 1, 2), (8.0, 2, 1), (0.5, 1, 1), (3.0, 3, 1)]
    visits = spark.createDataFrame([(a, s, datetime(2024, m, 3)) for a, s, m in rows], "amt double, store int, at timestamp")
    stores = spark.createDataFrame([(1, "Oslo"), (2, "Rome"), (3, "Bergen")], "id int, town string")
    return wb.to_model(book, {"Visits": visits, "Stores": stores})


def test_description(book):
    s = book.source("Shop")
    assert s.relations["Stores"].query == "SELECT * FROM stores" and s.relations["Visits"].table == "[public].[visits]"
    assert s.connections["pg.1"].kind == "postgres" and [e.right for e in s.edges] == ["Stores"]
    assert book.parameters["Parameter 2"].members == ("a", "b") and book.parameters["Parameter 1"].step == 5.0
    assert any("spatial" in w for w in s.warnings)


def test_views(book, model):
    assert {tuple(r) for r in run_view(model, wb.to_view(book, "Running")).collect()} == {("Oslo", 2.0, 1), ("Oslo", 8.0, 2), ("Rome", 8.0, 1)}
    got = [tuple(r) for r in run_view(model, wb.to_view(book, "Groups")).collect()]
    assert got == [("Rome", 8.0), ("Bergen", 3.0), ("North", 8.5 / 3)]


def test_calcs_of_the_file(model):
    got = run_view(model, {"fields": [{"fieldCaption": "Big"}, {"fieldCaption": "Size"}, {"fieldCaption": "Amount", "function": "SUM", "fieldAlias": "s"}]})
    assert {tuple(r) for r in got.collect()} == {(False, 0, 5.5), (True, 4, 6.0), (True, 8, 8.0)}


def test_refusals(book):
    found = wb.coverage(book)
    assert found["Running"] == found["Groups"] == "ok" and "CellInPane" in found["Pane"]
    with pytest.raises(UnsupportedCalc):
        wb.parse("no xml")
    with pytest.raises(UnsupportedCalc):
        book.source("Other")


def test_zipped(tmp_path, book):
    with zipfile.ZipFile(tmp_path / "b.twbx", "w") as z:
        z.writestr("x/b.twb", "﻿" + BOOK)
        z.writestr("data.csv", "")
    assert list(wb.load(str(tmp_path / "b.twbx")).sheets) == list(book.sheets)
    (tmp_path / "bad.twb").write_text("<")
    assert [isinstance(x, UnsupportedCalc) for x in wb.find(str(tmp_path)).values()] == [False, True]


GATED = """<workbook><datasources><datasource name='Parameters' hasconnection='false'>
<column caption='Pick' datatype='string' name='[Parameter 2]' value='&quot;a&quot;'><members><member value='&quot;a&quot;'/><member value='&quot;b&quot;'/></members></column></datasource>
<datasource caption='S' name='s'><connection class='postgres' server='h' dbname='d'/></datasource></datasources><worksheets>%s</worksheets></workbook>"""
GATE = """<worksheet name='%s'><table><view><datasource-dependencies datasource='s'><column datatype='string' name='[G]' role='dimension'><calculation formula='%s'/></column></datasource-dependencies>
<filter class='categorical' column='[s].[G]'><groupfilter function='%s' member='&quot;%s&quot;' level='[G]'/></filter></view><rows></rows></table></worksheet>"""


def test_sheet_swaps():
    passed = "[Parameters].[Parameter 2]"
    book = wb.parse(GATED % "".join([GATE % ("One", passed, "member", "a"), GATE % ("Two", passed, "member", "b"), GATE % ("Other", "[x]", "member", "a"), GATE % ("All", passed, "level-members", "a")]))
    assert wb.sheet_swaps(book) == {"Pick": {"One": ("a",), "Two": ("b",)}}
    assert wb.visible(book, {"Pick": "a"}) == ["One", "Other", "All"] and wb.visible(book, {}) == ["One", "Two", "Other", "All"]
    assert wb.sheet_swaps(wb.parse(GATED % (GATE % ("One", passed, "member", "a")))) == {}


def test_addressing_inside_panes():
    calc = lambda kind: ElementTree.fromstring(f"<table-calc ordering-type='{kind}'/>")
    names = {x: x.upper() for x in "abcde"}
    assert wb._addressing(calc("RowInPane"), ["a"], ["b", "c"], ["d"], names) == (("A", "B", "D"), (("C", False),))
    assert wb._addressing(calc("ColumnInPane"), ["a", "b"], ["c"], [], names) == (("C", "A"), (("B", False),))
    assert wb._addressing(calc("RowInPane"), ["a"], ["b"], [], names) == wb._addressing(calc("Rows"), ["a"], ["b"], [], names)
    with pytest.raises(UnsupportedCalc):
        wb._addressing(calc("RowInPane"), [], ["a", "b", "c"], [], names)
