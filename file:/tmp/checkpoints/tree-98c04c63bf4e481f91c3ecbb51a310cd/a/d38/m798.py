x798