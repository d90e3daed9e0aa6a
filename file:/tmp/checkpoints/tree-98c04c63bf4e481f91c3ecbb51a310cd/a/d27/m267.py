x267