"""Scalar functions as SQL fragments over a dialect: text clean-up, features of articles, codes and scores."""
