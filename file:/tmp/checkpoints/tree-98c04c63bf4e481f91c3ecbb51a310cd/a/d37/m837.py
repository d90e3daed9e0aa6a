x837