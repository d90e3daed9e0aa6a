x642