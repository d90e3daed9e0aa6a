x393