x941