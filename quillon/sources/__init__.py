"""Readers and writers for logs, tables, text trees and ledgers."""
