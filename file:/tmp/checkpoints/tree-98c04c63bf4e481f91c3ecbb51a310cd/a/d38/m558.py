x558