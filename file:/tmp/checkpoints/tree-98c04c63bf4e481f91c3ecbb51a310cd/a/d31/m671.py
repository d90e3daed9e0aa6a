x671