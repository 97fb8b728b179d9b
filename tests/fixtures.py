"""The library's sample projects, and entrypoints that must not be found in them."""

from weft.plans.samples import PROJECTS, package  # noqa: F401

#: Entrypoints that must not be found.
FORBIDDEN = {"express": {"GET /no"}, "laravel": {"DELETE /posts/comments/{comment}"}, "spring": {"ANY /api/users"}, "ktor": {"GET /api/root"}, "phoenix": {"GET /api/up"}}
