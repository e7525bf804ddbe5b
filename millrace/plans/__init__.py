"""Whole plans: conversion, and the registered queries."""
