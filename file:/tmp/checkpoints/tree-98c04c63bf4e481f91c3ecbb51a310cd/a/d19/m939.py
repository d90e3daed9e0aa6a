x939