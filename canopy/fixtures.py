"""Small source trees that the golden queries run on."""

from __future__ import annotations

SHOP = {
    "go.mod": "module example.test/shop\n\ngo 1.22\n",
    "pkg/domain/order.go": """// Package domain holds the records of the shop.
package domain

// OrderID names an order.
type OrderID string

// Order is what a customer asked for.
type Order struct {
\tID    OrderID
\tTotal int
\tnotes []string
}

// NewOrder makes an empty order.
func NewOrder(id OrderID) *Order {
\treturn &Order{ID: id}
}

func (o *Order) add(n int) {
\to.Total += n
}
""",
    "pkg/domain/customer.go": """package domain

type Customer struct{}

// Name gives the shown name.
func (c Customer) Name() string { return "nobody" }

type Visitor = Customer
""",
    "pkg/domain/order_test.go": """package domain

type fake struct{ Order }

func helper() int { return 1 }
""",
    "pkg/domain/store/store.go": """package store

import (
\t"context"

\t"example.test/shop/pkg/domain"
)

// Store keeps orders.
type Store interface {
\tSave(ctx context.Context, o *domain.Order) error
\tLoad(ctx context.Context, id domain.OrderID) (*domain.Order, error)
\tCloser
}

type Closer interface{ Close() }
""",
    "pkg/app/service.go": """/*
Package app runs
the shop.
*/
package app

import (
\t"example.test/shop/pkg/domain"
\tst "example.test/shop/pkg/domain/store"
\t"fmt"
)

type Service struct {
\tStore  st.Store
\tName   string
\tPort   int
\tHosts  []string
\tLimits map[string]int `json:"limits"`
\tlast   *domain.Order
}

func (s *Service) Run(n int, hosts ...string) error {
\tfmt.Println(n, hosts)

\t
\treturn nil
}

func (s *Service) Stop() {}

func (s *Service) reset() {}
""",
    "pkg/app/doc.go": "// Package app\npackage app\n",
    ".cache/gen.go": "package cache\n",
    "vendor/lib/lib.go": "package lib\n",
    "_draft/draft.go": "package draft\n\nfunc Draft()\n",
    "broken/broken.go": "package broken\n\nfunc Open(\n",
}

#: Files for edits: documentation, groups, tags.
EDITS = {
    "a.go": """package a

// T is a type.
type T struct {
\tID        int
\tFirstName string `xml:"n"`
\tHTTPPort  int
\tsecret    string
}

// M does it.
func (t *T) M() {
\tprintln(1)
}

func Free() {}
""",
    "group.go": """package a

type (
\t// One is first.
\tOne struct{}
\tTwo int
)
""",
}

READER = """type Reader interface {
\tRead(p []byte) (n int, err error)
\tSkip(int, string)
\tLog(format string, args ...any)
\tCloser
}"""

#: Two trees whose packages and types have the same names.
TREE_X = {
    "go.mod": "module example.test/x\n",
    "d/d.go": "package d\n\ntype Order int\n\ntype Store interface {\n\tSave(x, y int) (n, m int)\n\tOne() (err error)\n\tEach(f func(Order Order) bool, more ...Order)\n}\n",
    "t/t.go": "package t\n\ntype T struct{}\n\nfunc (T) One() error { return nil }\n",
}
TREE_Y = {
    "d/d.go": "package d\n\ntype Store interface{ Drop(n, m int) (a, b int) }\n",
    "t/t.go": "package t\n\ntype T struct{}\n",
}
