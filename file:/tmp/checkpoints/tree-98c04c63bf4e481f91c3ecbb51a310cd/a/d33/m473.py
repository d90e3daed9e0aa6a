x473