x870