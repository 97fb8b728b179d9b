"""Small source projects with what a scan of them must find: what the extraction queries and the tests read.

PROJECTS and ROUTES: unit, files, actionable frameworks (PROJECTS only), all entrypoints."""

PKG = '{"dependencies": {%s}}'


def package(*names):
    return PKG % ", ".join(f'"{n}": "1.0.0"' for n in names)


PROJECTS = {
    "angular": ({"package.json": package("@angular/core"), "angular.json": "{}", "src/app/users.component.ts": "import { Component } from '@angular/core';\n@Component({})\nexport class UsersComponent {}", "src/app/app-routing.module.ts": "import { Routes, RouterModule } from '@angular/router';\nconst routes: Routes = [{ path: 'users', component: UsersComponent }];"}, {"Angular"}, {"ROUTE /users"}),
    "react": ({"package.json": package("react", "react-router-dom"), "src/App.tsx": "import React from 'react';\nimport { Route } from 'react-router-dom';\nexport function App() { return <Route path=\"/users\" element={null} />; }"}, {"React"}, {"ROUTE /users"}),
    "next": ({"package.json": package("next", "react"), "next.config.js": "module.exports = {}", "app/users/[id]/page.tsx": "export default function UserPage() { return null }", "app/api/items/route.ts": "export async function GET() {}\nexport const POST = 1"}, {"Next.js"}, {"ROUTE /users/{id}", "GET /api/items", "POST /api/items"}),
    "vue": ({"package.json": package("vue"), "src/App.vue": "<template><div/></template>", "src/router.ts": "import { createRouter } from 'vue-router';\nexport default createRouter({ routes: [{ path: '/users' }] });"}, {"Vue"}, {"ROUTE /users"}),
    "nuxt": ({"package.json": package("nuxt"), "nuxt.config.ts": "export default defineNuxtConfig({})", "pages/users/[id].vue": "<template/>", "server/api/items.post.ts": "export default defineEventHandler(() => 1)"}, {"Nuxt"}, {"ROUTE /users/{id}", "POST /api/items"}),
    "svelte": ({"package.json": package("svelte"), "svelte.config.js": "export default {}", "src/App.svelte": "<svelte:head></svelte:head>"}, {"Svelte"}, set()),
    "sveltekit": ({"package.json": package("@sveltejs/kit", "svelte"), "svelte.config.js": "export default {}", "src/routes/users/[id]/+page.svelte": "<svelte:head></svelte:head>", "src/routes/api/+server.ts": "export function GET() {}"}, {"Svelte", "SvelteKit"}, {"ROUTE /users/{id}", "GET /api"}),
    "astro": ({"package.json": package("astro"), "astro.config.mjs": "export default {}", "src/pages/users/[id].astro": "---\nconst a = Astro.params;\n---"}, {"Astro"}, {"ROUTE /users/{id}"}),
    "nest": ({"package.json": package("@nestjs/core"), "src/users.controller.ts": "import { Controller, Get, Post } from '@nestjs/common';\n@Controller('users')\nexport class UsersController {\n  @Get(':id') one() {}\n  @Post() add() {}\n}"}, {"NestJS"}, {"GET /users/{id}", "POST /users"}),
    "express": ({"package.json": package("express"), "index.js": "const express = require('express');\nconst app = express();\napp.get('/health', h); // app.get('/no', h)\napp.post('/users', h);"}, {"Express"}, {"GET /health", "POST /users"}),
    "fastify": ({"package.json": package("fastify"), "index.js": "const f = Fastify();\nf.get('/health', async () => 1);"}, {"Fastify"}, {"GET /health"}),
    "hono": ({"package.json": package("hono"), "index.ts": "import { Hono } from 'hono';\nconst app = new Hono().basePath('/api');\napp.get('/health', (c) => c.text('ok'));"}, {"Hono"}, {"GET /api/health"}),
    "django": ({"requirements.txt": "Django==5.0", "manage.py": "import django.core", "site/urls.py": "from django.urls import path, include\nurlpatterns = [path('api/', include('users.urls'))]", "users/urls.py": "from django.urls import path\nurlpatterns = [path('users/', views.users)]"}, {"Django"}, {"ANY /api/users"}),
    "fastapi": ({"requirements.txt": "fastapi", "main.py": "app = FastAPI()\n@app.get('/health')\ndef health(): ...\n@app.post('/users')\ndef add(): ..."}, {"FastAPI"}, {"GET /health", "POST /users"}),
    "flask": ({"requirements.txt": "flask", "main.py": "app = Flask(__name__)\n@app.get('/health')\ndef health(): ...\n@app.route('/items', methods=['POST'])\ndef add(): ...\n@app.route('/plain')\ndef plain(): ..."}, {"Flask"}, {"GET /health", "POST /items", "GET /plain"}),
    "aspnet": ({"Api.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web"></Project>', "Program.cs": "var app = WebApplication.Create();\napp.MapGet(\"/health\", () => 1);\napp.MapPost(\"/users\", () => 1);", "Controllers/UsersController.cs": "[Route(\"api/[controller]\")]\npublic class UsersController : ControllerBase {\n  [HttpGet(\"{id}\")] public int One() => 1;\n}"}, {"ASP.NET"}, {"GET /health", "POST /users", "GET /api/Users/{id}"}),
    "blazor": ({"App.csproj": '<Project Sdk="Microsoft.NET.Sdk.BlazorWebAssembly"></Project>', "Pages/User.razor": "@page \"/users/{id}\"\n<h1/>"}, {"Blazor"}, {"ROUTE /users/{id}"}),
    "symfony": ({"composer.json": '{"require": {"symfony/framework-bundle": "7"}}', "bin/console": "#!/usr/bin/env php", "config/bundles.php": "<?php return [];", "src/Controller/UserController.php": "<?php\nclass UserController {\n  #[Route('/users/{id}', methods: ['GET'])]\n  public function one() {}\n}"}, {"Symfony"}, {"GET /users/{id}"}),
    "rails": ({"Gemfile": "gem 'rails'", "config/application.rb": "module A; end", "config/routes.rb": "Rails.application.routes.draw do\n  get '/health', to: 'h#i'\n  resources :users\nend", "app/controllers/users_controller.rb": "class UsersController < ApplicationController\nend"}, {"Rails"}, {"GET /health", "GET /users", "GET /users/new", "GET /users/{id}", "GET /users/{id}/edit", "POST /users", "PATCH /users/{id}", "DELETE /users/{id}"}),
    "go": ({"go.mod": "module x", "main.go": "package main\nimport \"net/http\"\nfunc main() { http.HandleFunc(\"/health\", h) }"}, {"Go web"}, {"ANY /health"}),
    "rust": ({"Cargo.toml": "[package]\nname = \"x\"\n[dependencies]\naxum = \"0.7\"", "src/main.rs": "use axum::Router;\nfn main() { Router::new().route(\"/health\", get(h)); }"}, {"Rust web"}, {"GET /health"}),
    "quarkus": ({"pom.xml": "<groupId>io.quarkus</groupId>", "src/main/java/R.java": "import jakarta.ws.rs.*;\n@Path(\"/api\")\npublic class R {\n  @GET\n  @Path(\"/users\")\n  public String u() { return \"\"; }\n}"}, {"Quarkus"}, {"GET /api/users"}),
    "micronaut": ({"build.gradle": "id 'io.micronaut.application'", "src/main/java/C.java": "import io.micronaut.http.annotation.*;\n@Controller(\"/api\")\npublic class C {\n  @Get(\"/users\")\n  String u() { return \"\"; }\n}"}, {"Micronaut"}, {"GET /api/users"}),
    "ktor": ({"build.gradle.kts": "implementation(\"io.ktor:ktor-server\")", "src/main/kotlin/A.kt": "fun Application.m() {\n  routing {\n    route(\"/api\") {\n      get(\"/health\") { call.respond(1) }\n    }\n    get(\"/root\") { }\n  }\n}"}, {"Ktor"}, {"GET /api/health", "GET /root"}),
    "phoenix": ({"mix.exs": "{:phoenix, \"~> 1.7\"}", "lib/web/router.ex": "defmodule W.Router do\n  use W, :router\n  scope \"/api\", W do\n    get \"/health\", H, :i\n    resources \"/users\", U\n  end\n  get \"/up\", H, :u\nend"}, {"Phoenix"}, {"GET /api/health", "GET /up", "GET /api/users", "GET /api/users/new", "GET /api/users/{id}", "GET /api/users/{id}/edit", "POST /api/users", "PATCH /api/users/{id}", "DELETE /api/users/{id}"}),
    "spring": ({"pom.xml": "<artifactId>spring-boot-starter-web</artifactId>", "src/main/java/U.java": "package a.b;\nimport a.b.Service1;\n@RestController @RequestMapping(\"/api/users\")\npublic class U {\n  @GetMapping(\"/{id}\") String one() { return \"\"; }\n}", "src/main/java/a/b/Service1.java": "package a.b;\npublic class Service1 {}"}, {"Spring Boot"}, {"GET /api/users/{id}"}),
    "laravel": ({"composer.json": '{"require": {"laravel/framework": "11"}}', "artisan": "#!/usr/bin/env php", "bootstrap/app.php": "<?php", "routes/web.php": "<?php\nRoute::get('/users/{user}', [U::class, 'show'])->name('users.show');\nRoute::prefix('admin')->middleware(['auth'])->group(function () {\n  Route::post('/reports', R::class);\n});\nRoute::apiResource('posts.comments', C::class)->except(['destroy']);"}, {"Laravel"}, {"GET /users/{user}", "POST /admin/reports", "GET /posts/comments/{comment}", "GET /posts/comments", "POST /posts/comments", "PUT /posts/comments/{comment}"}),
    "php-plain": ({"a.php": "<?php class Plain {}"}, set(), set()),
    "react-manifest-only": ({"package.json": package("react")}, set(), set()),
    "empty": ({"README.txt": "nothing"}, set(), set()),
}

ROUTES = {
    "flask": ({"requirements.txt": "flask", "m.py": "app = Flask(__name__)\n@app.route('/a', methods=['GET', \"POST\"])\ndef a(): ...\n@app.route('/b', strict_slashes=False, methods=('PUT',))\ndef b(): ...\n@app.route('/c')\ndef c(): ..."}, {"GET /a", "POST /a", "PUT /b", "GET /c"}),
    "symfony": ({"composer.json": '{"require": {"symfony/framework-bundle": "7"}}', "bin/console": "#", "src/C.php": "<?php\nclass C {\n  #[Route('/x/{id}', name: 'x', methods: ['GET', 'HEAD'])]\n  #[Route(path: '/y', methods: 'POST')]\n  public function a() {}\n}"}, {"GET /x/{id}", "HEAD /x/{id}", "POST /y"}),
    "fastify": ({"package.json": '{"dependencies": {"fastify": "4"}}', "i.js": "const f = fastify();\nf.route({ method: ['GET', 'PUT'], url: '/o/:id', handler });\nf.route({\n  url: '/p',\n  method: 'POST',\n  handler\n});\nf.get('/g', h);"}, {"GET /o/{id}", "PUT /o/{id}", "POST /p", "GET /g"}),
    "express": ({"package.json": '{"dependencies": {"express": "4"}}', "i.js": "const express = require('express');\nconst users = express.Router();\nusers.get('/u', h);\ncache.get('/no', h);\nlet shop = express();\nshop.post('/s', h);"}, {"GET /u", "POST /s"}),
    "spring": ({"pom.xml": "<artifactId>spring-boot-starter-web</artifactId>", "A.java": 'package a;\n@RestController\n@RequestMapping(path = {"/v1", "/v2"}, produces = "application/json")\npublic class A {\n  @GetMapping({"/one", "/{id}"}) String g() { return ""; }\n  @RequestMapping(value = "/m", method = {RequestMethod.PUT, RequestMethod.PATCH})\n  String m() { return ""; }\n  @PostMapping(consumes = "x/y") String p() { return ""; }\n  @RequestMapping("/none") String n() { return ""; }\n}'},
        {f"{m} /{v}{p}" for v in ("v1", "v2") for m, p in (("GET", "/one"), ("GET", "/{id}"), ("PUT", "/m"), ("PATCH", "/m"), ("POST", ""))}),
    "axum": ({"Cargo.toml": '[package]\nname = "x"\n[dependencies]\naxum = "0.7"', "src/main.rs": 'use axum::Router;\nfn app() -> Router { Router::new().nest("/api", api()).route("/up", get(h)) }\nfn api() -> Router { Router::new().route("/users", get(h)).nest("/deep", deep()) }\nfn deep() -> Router { Router::new().route("/x", post(h)) }'}, {"GET /up", "GET /api/users", "POST /api/deep/x"}),
}

#: unit, path, text of units that link to one another.
LINKED = [
    ("web", "package.json", '{"name": "web", "dependencies": {"react": "18", "@x/lib": "^1", "@angular/core": "17"}}'),
    ("web", "tsconfig.json", '{\n  // aliases\n  "compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["app/*"], "cfg": ["config.ts"],},},\n}'),
    ("web", "src/main.ts", "import { A } from '@app/api';\nimport c from 'cfg';\nimport { l } from '@x/lib';\nexport class Main {}"),
    ("web", "src/app/api.ts", "import { HttpClient } from '@angular/common/http';\nexport class Api {\n  constructor(private readonly client: HttpClient) {}\n  load(id: string) { return this.client.get<User>('/u', { params: f(id) }); }\n  odd() { return other.get('/zzz'); }\n  join() { return axios.post('/s' + '/t', body); }\n  far() { return fetch(`https://h.org/x?y=1`, { method: 'PUT' }); }\n  dyn() { return fetch(url); }\n}"),
    ("web", "src/config.ts", "export const c = 1;"),
    ("web", ".env", 'TOKEN="abcdefgh1234"'),
    ("lib", "package.json", '{"name": "@x/lib", "version": "1.0.0"}'), ("lib", "index.ts", "export function l() {}"),
    ("py", "requirements.txt", "x"), ("py", "a.py", "import b, c as d\nimport b.e"), ("py", "b.py", "def b(): ..."), ("py", "c.py", "def c(): ..."),
]
