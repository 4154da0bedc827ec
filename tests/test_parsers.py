"""The scanners on small sources of every language."""

import pytest

from sparklore.sources import parsers as P

RUST = """use std::{fs, io::{self, Read as R}};
use crate::util::helper;
/// docs { not a brace
pub struct Service { name: String }
trait Runner: Base { fn go(&self); }
impl Runner for Service {
    fn go(&self) { self.step(); helper(1); let s = "fn fake() {"; }
}
impl Service {
    pub fn step(&self) -> u8 { Other::make::<u8>(2) }
}
#[test]
fn works() { assert!(true); Service::new().go(); }
"""
TS = """import express, { Router as R } from 'express';
import * as util from './util';
class Car extends Vehicle implements Thing {
  private speed(): number { return this.inner(1); }
  async go(x: number) { util.log(x); }
}
const twice = (n: number) => { return add(n, n); };
export function main() { const c = new Car(); c.go(2); }
app.get('/cars', auth, listCars);
router.post(`/cars`, ctrl.create);
"""
PHP = """<?php
use App\\Models\\{User, Post as P};
class UserController extends Base implements Thing {
    // function fake() {}
    public function show($id) { return User::find($id) ?? $this->missing(); }
    private function missing() { return view('x'); }
}
Route::get('/u', [UserController::class, 'show']);
Route::match(['get', 'post'], '/m', 'UserController@show');
Route::resource('posts', PostController::class);
Route::post('/i', Invoker::class);
"""
GO = """package a
import (
    "fmt"
    "x/y/store"
)
type Base struct { }
type Server struct {
    Base
    name string
}
func (s *Server) Run(n int) error { fmt.Println(n); return s.stop() }
func TestRun(t *testing.T) { helper() }
func helper() {}
"""
JAVA = """import java.util.List;
public class Shop extends Store implements Open, Close {
    private int n;
    public Shop(int n) { this.n = n; }
    @Test
    public List<String> items(String a) throws E { return list.map(a); }
    interface Inner { }
}
"""
PY = """from fastapi import APIRouter
import helpers
@router.get("/a")
def a():
    helpers.run()
    thing.go()
@app.route("/b", methods=["POST", "PUT"])
def b(): pass
@bus.on_event("start")
def c(): pass
TABLE = {"x": a, "y": b}
class T(Base):
    def test_it(self):
        self.one()
"""


def by(source, language, kind, *fields):
    at = [P.FIELDS.index(f) for f in fields]
    return {tuple(tuple(r[i]) if isinstance(r[i], list) else r[i] for i in at) for r in P.parse_source(source, language) if r[0] == kind}


def test_rust():
    assert by(RUST, "rust", "function", "qualified_name", "line_start", "line_end", "is_test") == {("Runner::go", 5, 5, False), ("Service::go", 7, 7, False), ("Service::step", 10, 10, False), ("works", 13, 13, True)}
    assert by(RUST, "rust", "class", "name", "bases") == {("Service", ("Runner",)), ("Runner", ("Base",))}
    assert by(RUST, "rust", "import", "name", "qualified_name") == {("fs", "std::fs"), ("self", "std::io::self"), ("R", "std::io::Read"), ("helper", "crate::util::helper")}
    calls = by(RUST, "rust", "call", "caller", "name", "receiver", "is_method")
    assert {("Service::go", "step", "self", True), ("Service::go", "helper", None, False), ("Service::step", "make", "Other", False), ("works", "new", "Service", False)} <= calls


def test_typescript():
    assert {q for (q,) in by(TS, "typescript", "function", "qualified_name")} == {"Car.speed", "Car.go", "twice", "main"}
    assert by(TS, "typescript", "class", "name", "bases") == {("Car", ("Vehicle", "Thing"))}
    assert by(TS, "typescript", "import", "name", "qualified_name") == {("express", "express"), ("R", "express"), ("util", "./util")}
    assert {("Car.speed", "inner", "this"), ("Car.go", "log", "util"), ("twice", "add", None), ("main", "go", "c")} <= by(TS, "typescript", "call", "caller", "name", "receiver")
    assert by(TS, "typescript", "route", "name", "qualified_name", "caller") == {("GET", "/cars", "listCars"), ("POST", "/cars", "create")}


def test_php():
    assert {q for (q,) in by(PHP, "php", "function", "qualified_name")} == {"UserController::show", "UserController::missing"}
    assert by(PHP, "php", "class", "name", "bases") == {("UserController", ("Base", "Thing"))}
    assert by(PHP, "php", "import", "name", "qualified_name") == {("User", "App\\Models\\User"), ("P", "App\\Models\\Post")}
    assert {("find", "User", False), ("missing", "$this", True), ("view", None, False)} <= by(PHP, "php", "call", "name", "receiver", "is_method")
    assert by(PHP, "php", "route", "name", "qualified_name", "receiver", "caller") == {("GET", "/u", "UserController", "show"), ("GET", "/m", "UserController", "show"), ("POST", "/m", "UserController", "show"), ("RESOURCE", "posts", "PostController", None), ("POST", "/i", "Invoker", "__invoke")}


def test_go():
    assert by(GO, "go", "function", "qualified_name", "is_test") == {("Server.Run", False), ("TestRun", True), ("helper", False)}
    assert by(GO, "go", "class", "name", "bases") == {("Base", ()), ("Server", ("Base",))}
    assert by(GO, "go", "import", "name", "qualified_name") == {("fmt", "fmt"), ("store", "x/y/store")}
    assert {("Server.Run", "Println", "fmt"), ("Server.Run", "stop", "s"), ("TestRun", "helper", None)} <= by(GO, "go", "call", "caller", "name", "receiver")


def test_java():
    assert by(JAVA, "java", "function", "qualified_name", "is_test") == {("Shop.Shop", False), ("Shop.items", True)}
    assert by(JAVA, "java", "class", "name", "bases", "line_end") == {("Shop", ("Store", "Open", "Close"), 8), ("Inner", (), 7)}
    assert by(JAVA, "java", "import", "name", "qualified_name") == {("List", "java.util.List")}
    assert ("Shop.items", "map", "list") in by(JAVA, "java", "call", "caller", "name", "receiver")


def test_python():
    assert by(PY, "python", "route", "name", "qualified_name", "caller") == {("GET", "/a", "a"), ("POST", "/b", "b"), ("PUT", "/b", "b"), ("EVENT", "start", "c")}
    assert {("a", "run", "helpers", False), ("a", "go", "thing", True), ("<dispatch>", "b", None, True), ("T.test_it", "one", "self", False)} <= by(PY, "python", "call", "caller", "name", "receiver", "is_method")
    assert by(PY, "python", "class", "name", "bases") == {("T", ("Base",))}


@pytest.mark.parametrize("language", [*P.RULES, "python", "html", "other"])
def test_odd_sources_do_not_fail(language):
    for source in ("", "{{{", "}}}", "fn", "class", "import", "\x00\n'\"`", "def f(:\n", RUST, TS, PHP, GO, JAVA, PY):
        assert isinstance(P.parse_source(source, language), list)


def test_files_as_rows(spark):
    rows = [("a.rs", "rust", RUST), ("b.ts", "typescript", TS), ("c.html", "html", "<p>"), ("d.go", "go", None)]
    found = P.parse_files(spark.createDataFrame(rows, "path string, language string, source string"))
    assert {r.path for r in found.collect()} == {"a.rs", "b.ts"}
